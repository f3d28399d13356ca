"""URL filters, quality rules and benchmark decontamination as registered queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from arborlift.llm import decontaminate, quality, url_rules
from arborlift.llm.base import LOWER, UPPER, query, table, whole


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _low(s: str) -> str:
    return f"translate({s},'{UPPER}','{LOWER}')"


def _url_sql() -> str:
    rules = sorted(url_rules.HOST_RULES, key=lambda r: -len(r[1] + r[2]))
    fits = [(w, f"((host={_quoted(h)} OR host LIKE {_quoted('%.' + h)}) AND starts_with(path,{_quoted(p)}))", h + p) for w, h, p in rules]
    rule = "CASE " + " ".join(f"WHEN {c} THEN {_quoted(r)}" for _, c, r in fits) + " END"
    verdict = "CASE " + " ".join(f"WHEN {c} THEN {_quoted(w)}" for w, c, _ in fits) + " END"
    pattern = "CASE " + " ".join(
        f"WHEN regexp_matches({_low('url')},{_quoted(r)}) THEN {_quoted(n)}" for n, r, _ in sorted(url_rules.PATTERNS)) + " END"
    return f"""WITH u AS (SELECT page_id, url, CASE WHEN contains(url,'://') THEN substr(url, instr(url,'://')+3) ELSE '' END AS rest FROM pages),
s AS (SELECT page_id, {_low("regexp_extract(rest,'^([^/?#]*)',1)")} AS host, regexp_extract(rest,'^[^/?#]*([^?#]*)',1) AS path, {pattern} AS pattern FROM u)
SELECT page_id, host, path, {rule} AS rule, coalesce({verdict}, CASE WHEN pattern IS NOT NULL THEN 'block' END, 'allow') AS verdict, pattern FROM s"""


def _quality_sql() -> str:
    q = quality
    words = "list_filter(regexp_split_to_array(coalesce(text,''),'[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
    bare = f"regexp_replace(%s,'[\\x20\\x09-\\x0D]','','g')"
    stats, pairs = q.STATS, [(i, j) for i in range(4) for j in range(i + 1)]
    same = "v.lang IS NOT DISTINCT FROM g.lang AND v.source IS NOT DISTINCT FROM g.source"
    long = lambda src, value: " UNION ALL ".join(
        f"SELECT v.lang,v.source,'{k}' AS stat,CAST(floor(({value(k)})/{q.BIN}) AS BIGINT) AS b FROM {src}" for k in stats)
    median = lambda name, src: (
        f"{name}_c AS (SELECT lang,source,stat,b,count(*) AS c FROM ({src}) GROUP BY ALL), "
        f"{name}_u AS (SELECT *,sum(c) OVER (PARTITION BY lang,source,stat ORDER BY b) AS upto,sum(c) OVER (PARTITION BY lang,source,stat) AS n FROM {name}_c), "
        f"{name}_m AS (SELECT lang,source,stat,min(b) AS b,max(n) AS n FROM {name}_u WHERE 2*upto>=n GROUP BY ALL)")
    wide = lambda src, suffix: f"SELECT lang,source,max(n) AS n," + ",".join(
        f"max(CASE WHEN stat='{k}' THEN (b+0.5)*{q.BIN} END) AS {k}{suffix}" for k in stats) + f" FROM {src} GROUP BY lang,source"
    z = [f"((v.{k}-g.{k}_mid)/g.{k}_dev)" for k in stats]

    def dist(z: list[str]) -> str:
        y: list[str] = []
        for i in range(4):
            y.append(f"(({z[i]}-g.m{i + 1}" + "".join(f"-g.f{i + 1}{k + 1}*{y[k]}" for k in range(i)) + f")/g.f{i + 1}{i + 1})")
        return "+".join(f"{v}*{v}" for v in y)

    parts = [f"""r AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text,'') AS text, {words} AS w FROM documents)""",
             """g3 AS (SELECT rid, i, w[i]||' '||w[i+1]||' '||w[i+2] AS g FROM (SELECT rid, w, unnest(generate_series(1,len(w)-2)) AS i FROM r WHERE len(w)>2))""",
             """t3 AS (SELECT rid, i, count(*) OVER (PARTITION BY rid,g) AS k FROM g3)""",
             """rep AS (SELECT rid, count(DISTINCT i+o) AS n FROM t3, (VALUES (0),(1),(2)) AS o(o) WHERE k>1 GROUP BY rid)""",
             f"""ln AS (SELECT r.*, list_filter(string_split(text, chr(10)), lambda x: {bare % 'x'} <> '') AS lines FROM r)""",
             f"""cnt AS (SELECT ln.rid, doc_id, lang, source, len(w) AS n_words, length({bare % 'text'}) AS word_chars,
 length(text)-length(regexp_replace(text,'[#*$%&|<>]','','g')) AS n_symbols, len(lines) AS n_lines, len(lines)-len(list_distinct(lines)) AS n_dup_lines,
 coalesce(rep.n,0) AS n_repeat_words FROM ln LEFT JOIN rep USING (rid))""",
             """ok AS (SELECT *, (n_words<50 OR 100*n_repeat_words>50*n_words) AS base_failed FROM cnt)""",
             """x AS (SELECT lang,source,rid,ln(word_chars::DOUBLE/n_words) AS x1,sqrt(n_symbols::DOUBLE/word_chars) AS x2,sqrt(n_dup_lines::DOUBLE/n_lines) AS x3,
 sqrt(n_repeat_words::DOUBLE/n_words) AS x4 FROM ok WHERE NOT base_failed)""",
             median("a", long("x v", lambda k: f"v.{k}")), f"mid AS ({wide('a_m', '_mid')})",
             median("d", long(f"x v JOIN mid g ON {same}", lambda k: f"abs(v.{k}-g.{k}_mid)")), f"dv AS ({wide('d_m', '_d')})",
             "k0 AS (SELECT v.*," + ",".join(f"greatest(g.{k}_d*1.4826,{f})::DOUBLE AS {k}_dev" for k, f in zip(stats, q.FLOORS, strict=True))
             + "," + ",".join(f"0.0::DOUBLE AS m{i + 1}" for i in range(4)) + "," + ",".join(f"{1.0 if i == j else 0.0}::DOUBLE AS f{i + 1}{j + 1}" for i, j in pairs)
             + f" FROM mid v JOIN dv g ON {same})"]
    for s in range(q.STEPS):
        parts += [
            f"n{s} AS (SELECT v.lang,v.source," + ",".join(f"{c} AS z{i + 1}" for i, c in enumerate(z)) + f",CAST(floor(8*log2(1e-6+{dist(z)})) AS BIGINT) AS b FROM x v JOIN k{s} g ON {same})",
            f"s{s} AS (SELECT lang,source,b,count(*) AS k," + ",".join(f"sum(z{i + 1}) AS s{i + 1}" for i in range(4)) + "," + ",".join(f"sum(z{i + 1}*z{j + 1}) AS p{i + 1}{j + 1}" for i, j in pairs) + f" FROM n{s} GROUP BY lang,source,b)",
            f"u{s} AS (SELECT *,sum(k) OVER (PARTITION BY lang,source ORDER BY b) AS upto,sum(k) OVER (PARTITION BY lang,source) AS al FROM s{s})",
            f"t{s} AS (SELECT lang,source,sum(k)::DOUBLE AS k," + ",".join(f"sum(s{i + 1})/sum(k)::DOUBLE AS m{i + 1}" for i in range(4)) + "," + ",".join(f"sum(p{i + 1}{j + 1}) AS p{i + 1}{j + 1}" for i, j in pairs) + f" FROM u{s} WHERE upto-k<{q.SUPPORT}*al GROUP BY lang,source)",
            f"c{s} AS (SELECT lang,source,m1,m2,m3,m4," + ",".join(f"{q.CONSISTENCY}*(p{i + 1}{j + 1}/k-m{i + 1}*m{j + 1})" + (f"+{q.RIDGE}" if i == j else "") + f" AS a{i + 1}{j + 1}" for i, j in pairs) + f" FROM t{s})"]
        prev = f"c{s}"
        for j in range(4):  # one column of the factor after another
            done = "".join(f"-f{j + 1}{k + 1}*f{j + 1}{k + 1}" for k in range(j))
            parts.append(f"h{s}{j} AS (SELECT *,sqrt(a{j + 1}{j + 1}{done}) AS f{j + 1}{j + 1} FROM {prev})")
            prev = f"h{s}{j}"
            if j < 3:
                parts.append(f"l{s}{j} AS (SELECT *," + ",".join(
                    f"(a{i + 1}{j + 1}" + "".join(f"-f{i + 1}{k + 1}*f{j + 1}{k + 1}" for k in range(j)) + f")/f{j + 1}{j + 1} AS f{i + 1}{j + 1}" for i in range(j + 1, 4)) + f" FROM {prev})")
                prev = f"l{s}{j}"
        parts.append(f"k{s + 1} AS (SELECT v.lang,v.source,v.n," + ",".join(f"v.{k}_mid,v.{k}_dev" for k in stats) + ","
                     + ",".join(f"g.m{i + 1}" for i in range(4)) + "," + ",".join(f"g.f{i + 1}{j + 1}" for i, j in pairs) + f" FROM k{s} v JOIN {prev} g ON {same})")
    parts.append(f"far AS (SELECT v.rid,g.n,{dist(z)} AS d FROM x v JOIN k{q.STEPS} g ON {same})")
    return "WITH " + ", ".join(parts) + f""" SELECT doc_id,n_words,word_chars,n_symbols,n_dup_lines,n_repeat_words,base_failed,
 NOT base_failed AND coalesce(far.n<{q.MIN_ROWS} OR far.d<={q.CUTOFF},false) AS kept FROM ok LEFT JOIN far USING (rid)"""


LEAKS = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array({_low("coalesce(text,'')")},'[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array({_low("coalesce(text,'')")},'[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bg AS (SELECT DISTINCT item_id, least(len(w),10) AS k, array_to_string(w[i:i+least(len(w),10)-1],' ') AS g
 FROM (SELECT item_id, w, unnest(generate_series(1,greatest(len(w)-9,1))) AS i FROM b WHERE len(w)>0)),
dg AS (SELECT rid, i, k, array_to_string(w[i:i+k-1],' ') AS g FROM (SELECT rid, w, k, unnest(generate_series(1,len(w)-k+1)) AS i
 FROM d, (SELECT DISTINCT k FROM bg) WHERE len(w)>=k)),
hit AS (SELECT rid, i, k, g FROM dg SEMI JOIN bg USING (k,g)),
cov AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(generate_series(i,i+k-1)) AS p FROM hit) GROUP BY rid),
it AS (SELECT rid, count(*) AS n, sha256(string_agg(s,',' ORDER BY s)) AS h FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS s FROM hit JOIN bg USING (k,g)) GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(cov.n,0) AS n_hit, coalesce(it.n,0) AS n_items, coalesce(it.h,sha256('')) AS items_sha256, coalesce(cov.n,0)>0 AS contaminated
FROM d LEFT JOIN cov USING (rid) LEFT JOIN it USING (rid)"""


@query("op6_url_filters", _url_sql())
def _(spark, d):
    return url_rules.judge(table(spark, d, "pages"))


@query("op8_quality_rules", _quality_sql())
def _(spark, d):
    return quality.judge_quality(table(spark, d, "documents")).drop("distance2")


@query("op10_benchmark_decontamination", LEAKS)
def _(spark, d):
    docs = table(spark, d, "documents")
    leaks = decontaminate.find_leaks(docs, table(spark, d, "benchmark"))
    counted = docs.select(
        "doc_id", F.xxhash64(whole("text")).alias("text_hash"),
        F.size(decontaminate.leak_words("text")).cast("bigint").alias("n_words"))
    found = counted.join(
        leaks, F.col("doc_id").eqNullSafe(F.col("leak_id")) & (F.col("text_hash") == F.col("leak_hash")), "left")
    none = F.array().cast("array<string>")
    n_hit = F.coalesce(decontaminate.covered(F.col("spans")), F.lit(0).cast("bigint"))
    return found.select(
        "doc_id", "n_words",
        n_hit.alias("n_hit"),
        F.size(F.coalesce("items", none)).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.coalesce("items", none), ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )
