"""Token files and sequence packing as registered queries."""

from __future__ import annotations

from arborlift.llm import packing, token_files
from arborlift.llm.base import query, table
from arborlift.session import shared_path


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op7_best_fit_packing")
def _(spark, d):
    cut = packing.pieces(table(spark, d, "documents"), vocabulary("word_bpe_49k.json"))
    return packing.pack(cut)


@query("op9_token_id_output")
def _(spark, d):
    path = shared_path(spark, "token-files")
    token_files.write_token_files(table(spark, d, "documents"), path, vocabulary("byte_bpe_50k.json"))
    return token_files.read_token_files(spark, path, with_ids=False)
