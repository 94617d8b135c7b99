"""One query for each corpus operator, over its whole table with production parameters, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.llm import bpe, jaccard, langid, lines, media, packing, quality, runs, spelling, substrings, tokenfiles, urls
from glyphmill.llm.shared import let, new_path, texts


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts, padded, stored as audio declared as plain bytes; sniffed, carved out again and read back."""
    docs = texts(documents(spark, sf_dir)).select("doc_id", F.col("text").cast("binary").alias("raw"))
    docs = docs.withColumn("n_bytes", F.octet_length("raw").cast("long"))
    padded = F.greatest(F.lit(64), F.ceil(F.col("n_bytes") / 64).cast("int") * 64)
    docs = docs.select("doc_id", "n_bytes", F.rpad("raw", padded, F.lit(b"\0")).alias("payload"))
    held = media.store_samples(docs).drop("payload").withColumn("declared", F.lit(media.UNKNOWN))
    found = media.carve(media.sniff(held)).where("medium_start = 0 AND medium_type = 'audio/wav'")
    return media.read_samples(found).select(
        "doc_id", "n_bytes",
        F.octet_length("samples").cast("long").alias("payload_bytes"),
        F.sha2("samples", 256).alias("payload_sha256"),
        "tail_crc32",
        F.octet_length("medium").cast("long").alias("media_bytes"),
        F.sha2("medium", 256).alias("media_sha256"),
        "feature",
        F.col("medium_type").alias("media_type"),
    )


def op2_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path("byte_bpe_50k.json")
    encoded = bpe.encode_texts(texts(documents(spark, sf_dir)), path).select("doc_id", "ids")
    decoded = bpe.decode_ids(encoded, path)
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = langid.fit(docs, ~held_out)
    return langid.predict(docs.select("doc_id", held_out.alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(documents(spark, sf_dir)).withColumn("n_bytes", F.octet_length("text").cast("long"))
    counted = bpe.count_tokens(docs, tokenizer_path("byte_bpe_50k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return quality.quality(docs, keep_text=False).select("doc_id", *base)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.token_pieces(texts(documents(spark, sf_dir)), tokenizer_path("word_bpe_49k.json"))
    return packing.pack(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(documents(spark, sf_dir), n=4, t=85)


OP7_SQL = r"""
WITH RECURSIVE t AS MATERIALIZED (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
    FROM documents
), grams AS MATERIALIZED (
    SELECT DISTINCT doc_id, md5_number(array_to_string(w[i:i + 3], ' ')) AS g FROM t, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS u(i) WHERE len(w) > 0
), sizes AS MATERIALIZED (
    SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id
), common AS (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM grams x JOIN grams y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2
), links AS MATERIALIZED (
    SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * o >= 85 * (p.n + q.n - o)
), reach AS (
    SELECT doc_id, doc_id AS other FROM t UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other
)
SELECT doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(other)::BIGINT AS component_id FROM reach LEFT JOIN sizes USING (doc_id) GROUP BY doc_id
"""


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


#: Verdict and host/path of each rule.
URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return urls.judge(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


#: Levels of the tree that the SQL of op9 has; what lies deeper it leaves as it is.
URL_LEVELS = 6


def url_sql() -> str:
    """SQL of op9: a few common tables for each level of the template tree."""
    fits = " ".join(
        f"WHEN (host = '{rule.partition('/')[0]}' OR host LIKE '%.{rule.partition('/')[0]}') AND starts_with(path, '/{rule.partition('/')[2]}') THEN '{rule}'"
        for _, rule in sorted(URL_RULES, key=lambda r: -len(r[1]))
    )
    says = " ".join(f"WHEN rule = '{rule}' THEN '{said}'" for said, rule in URL_RULES)

    def pure(b: str, a: str, towards: str = f"{urls.PRIOR}::DOUBLE") -> str:
        return f"(({b}) + ({towards}) * {urls.WEIGHT}::DOUBLE) / (({b}) + ({a}) + {urls.WEIGHT}::DOUBLE)"

    def told(b: str, a: str, e: str, t: str, n: str) -> tuple[str, str]:
        share = f"{urls.WEIGHT}::DOUBLE / nullif({n}, 0)"
        return f"({b}) + coalesce(({e}) * ({share}), 0)", f"({a}) + coalesce((({t}) - ({e})) * ({share}), 0)"

    own, pool = told("ob", "oa", "oe", "ot", "own"), told("pb", "pa", "pe", "pt", "size")
    others = pure(*told("pb - ob", "pa - oa", "pe - oe", "pt - ot", "size - own"))
    each = "sum(n)::DOUBLE AS own, sum(blocked)::BIGINT AS ob, sum(allowed)::BIGINT AS oa, sum(expected) AS oe, sum(told)::BIGINT AS ot"
    whole = "sum(own) AS size, sum(ob)::BIGINT AS pb, sum(oa)::BIGINT AS pa, sum(oe) AS pe, sum(ot)::BIGINT AS pt"
    sql = f"""
WITH split AS MATERIALIZED (
    SELECT page_id, translate(coalesce(regexp_extract(url, '{urls.PARTS}', 1), ''), '{urls.UPPER}', '{urls.LOWER}') AS host,
           coalesce(regexp_extract(url, '{urls.PARTS}', 2), '') AS path FROM pages
), ruled AS MATERIALIZED (
    SELECT *, CASE {fits} END AS rule, regexp_replace(path, '[0-9]+', '*', 'g') AS shape FROM split
), labelled AS MATERIALIZED (
    SELECT *, CASE {says} END AS said FROM ruled
), p0 AS MATERIALIZED (
    SELECT host, shape, count(*) AS n, sum((said IS NOT NULL AND said = 'block')::INT)::BIGINT AS blocked, sum((said IS NOT NULL AND said = 'allow')::INT)::BIGINT AS allowed,
           0::BIGINT AS told, {urls.PRIOR}::DOUBLE AS prior, regexp_extract(shape, '^(/[^/]*)?', 0) AS first, regexp_extract(host, '[^.]*$', 0) AS label, regexp_extract(host, '([^.]*[.])?[^.]*$', 0) AS domain
    FROM labelled GROUP BY host, shape
)"""
    for k, by in enumerate(("first", "shape", "label, shape", "domain, shape"), 1):
        mine = "(SELECT host, first, sum(blocked)::BIGINT AS ob, sum(allowed)::BIGINT AS oa FROM p0 GROUP BY ALL) AS o USING (host, first)" if k == 1 else "(SELECT host, shape, blocked AS ob, allowed AS oa FROM p0) AS o USING (host, shape)"
        sql += f"""
, p{k} AS MATERIALIZED (SELECT p{k - 1}.* REPLACE ({"CASE WHEN b - ob + a - oa > 0 THEN n ELSE 0 END AS told, " if k == 1 else ""}{pure("b - ob", "a - oa", "prior")} AS prior) FROM p{k - 1} JOIN (SELECT {by}, sum(blocked)::BIGINT AS b, sum(allowed)::BIGINT AS a FROM p0 GROUP BY {by}) AS s USING ({by}) JOIN {mine})"""
    sql += """
, t0 AS MATERIALIZED (SELECT host, shape, n, blocked, allowed, told, told * prior AS expected, '' AS node, shape AS rest FROM p4)"""
    for d in range(1, URL_LEVELS + 1):
        sql += f"""
, g{d} AS MATERIALIZED (SELECT *, rest <> '' AND min(rest) OVER w < max(rest) OVER w AS goes FROM t{d - 1} WINDOW w AS (PARTITION BY host, node))
, s{d} AS MATERIALIZED (SELECT * EXCLUDE (goes), regexp_extract(rest, '^/[^/]*', 0) AS seg, substring(rest, length(regexp_extract(rest, '^/[^/]*', 0)) + 1) AS tail FROM g{d} WHERE goes)
, e{d} AS MATERIALIZED (SELECT host, node, seg, {each} FROM s{d} GROUP BY ALL)
, n{d} AS (SELECT host, node, log2(sum(own)) - sum(own * log2(own)) / sum(own) AS spread, {whole}, count(*) AS k FROM e{d} GROUP BY ALL)
, a{d} AS (SELECT *, coalesce(k > 1 AND abs({pure(*own, others)} - ({others})) > {urls.GAP}, false) AS alone FROM e{d} JOIN n{d} USING (host, node))
, k{d} AS (SELECT host, node, seg, alone, spread > log2({urls.MAX_CHILDREN}) AND {urls.MAX_CHILDREN} * own < size AND NOT alone AS wide FROM a{d})
, u{d} AS MATERIALIZED (SELECT s{d}.* REPLACE (CASE WHEN wide THEN '/*' ELSE seg END AS seg), alone FROM s{d} JOIN k{d} USING (host, node, seg))
, c{d} AS MATERIALIZED (SELECT host, node, seg, tail, sum(n)::DOUBLE AS c FROM u{d} GROUP BY ALL)
, q{d} AS (SELECT host, node, tail, sum(c) AS pc FROM c{d} GROUP BY ALL)
, o{d} AS (SELECT host, node, seg, {each} FROM u{d} GROUP BY ALL)
, r{d} AS (SELECT host, node, {whole} FROM o{d} GROUP BY ALL)
, m{d} AS (SELECT host, node, seg, true AS near FROM c{d} JOIN q{d} USING (host, node, tail) JOIN o{d} USING (host, node, seg) JOIN r{d} USING (host, node)
    GROUP BY host, node, seg, own, size, ob, oa, oe, ot, pb, pa, pe, pt
    HAVING 100 * (sum(abs(c * size - pc * own)) + own * (size - sum(pc))) <= {2 * urls.MERGE} * own * size AND abs({pure(*own)} - {pure(*pool)}) <= {urls.GAP})
, t{d} AS MATERIALIZED (SELECT host, shape, n, blocked, allowed, told, expected, node || CASE WHEN near AND NOT alone THEN '/*' ELSE seg END AS node, tail AS rest FROM u{d} LEFT JOIN m{d} USING (host, node, seg))"""
    every = " UNION ALL ".join([*(f"SELECT * EXCLUDE (goes) FROM g{d} WHERE NOT goes" for d in range(1, URL_LEVELS + 1)), f"SELECT * FROM t{URL_LEVELS}"])
    return sql + f"""
, named AS MATERIALIZED (SELECT host, shape, n, blocked, allowed, told, expected, node || rest AS template FROM ({every}))
, judged AS (SELECT host, template, {pure(*told("sum(blocked)", "sum(allowed)", "sum(expected)", "sum(told)", "sum(n)"))} AS purity FROM named GROUP BY host, template)
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN purity > {urls.LIMIT} THEN 'block' ELSE 'allow' END) AS verdict
FROM labelled JOIN named USING (host, shape) JOIN judged USING (host, template)
"""


OP10_SQL = r"""
WITH t AS MATERIALIZED (
    SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
), windows AS MATERIALIZED (
    SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM t, unnest(range(1, len(w) - 48)) AS u(i) WHERE len(w) >= 50
), owners AS (
    SELECT h, min(doc_id) AS owner FROM windows GROUP BY h HAVING min(doc_id) < max(doc_id)
), gone AS (
    SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 50)) AS p FROM windows JOIN owners USING (h) WHERE owner < doc_id)
), lost AS (
    SELECT doc_id, list(p) AS ps, count(*) AS n FROM gone GROUP BY doc_id
), kept AS (
    SELECT doc_id, string_agg(w, ' ' ORDER BY p) AS text
    FROM (SELECT doc_id, unnest(w) AS w, unnest(range(1, len(w) + 1)) AS p FROM t) ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM t LEFT JOIN lost USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substrings.remove_repeats(documents(spark, sf_dir).select("doc_id", "text"), spaced=True)
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling.word_counts(documents(spark, sf_dir).select("doc_id", "text"), spoil=31)
    return spelling.spelling_groups(words).select("word", "form", "root", "n", "n_near", "form_n")


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "token-files")
    tokenfiles.write_files(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"), folder)
    found = tokenfiles.documents_of(tokenfiles.open_files(spark, folder))
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def with_repeated_tails(docs: DataFrame) -> DataFrame:
    """docs where the words of every tenth document (by crc32 of its key), from some word on, repeat those from there with some period."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g, words = F.floor(h / 10), F.filter(F.split("text", "[\\x20\\x09-\\x0D]+", -1), lambda w: w != "")

    def tail(w: Column) -> Column:
        n = F.size(w)

        def repeated(v: Column) -> Column:
            return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(w, F.when(i < v["a"], i).otherwise(v["a"] + (i - v["a"]) % v["p"]).cast("int")))

        a = F.pmod(g, n)
        return F.when(n > 0, F.array_join(let(F.struct(a.alias("a"), (1 + F.floor((n - a) / (3 + g % 8))).alias("p")), repeated), " ")).otherwise("")

    return docs.withColumn("text", F.when(h % 10 == 0, let(words, tail)).otherwise(F.col("text")))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_repeated_tails(texts(documents(spark, sf_dir)))
    found = runs.periodic_runs(docs)
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.withColumn("longest", longest).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("longest.start")).alias("start"),
        F.col("longest.length").alias("length"),
        (-F.col("longest.period")).alias("period"),
        F.expr("1000 * longest.length DIV -longest.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_media_columns": op1_media_columns,
    "op2_bpe_codec": op2_bpe_codec,
    "op3_language_id": op3_language_id,
    "op4_token_counts": op4_token_counts,
    "op5_quality_rules": op5_quality_rules,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_ngram_jaccard_join": op7_ngram_jaccard_join,
    "op8_line_dedup": op8_line_dedup,
    "op9_url_filters": op9_url_filters,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_token_files": op12_token_files,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLES: dict[str, str] = {
    "op7_ngram_jaccard_join": OP7_SQL,
    "op9_url_filters": url_sql(),
    "op10_substring_dedup": OP10_SQL,
}
