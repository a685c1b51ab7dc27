"""The registered queries of the training-data operators and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import decontaminate, kdtree, licenses, lloyd, lm, media, mixing, quality, simhash, tokencount, tokenstore, trie, warc
from tessella.llm.common import table


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file is; every machine has these files."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.round_trip(table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kdtree.partition(table(spark, sf_dir, "documents"))


def op6_tokenstore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenstore.round_trip(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("digest")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_print(F.col("fp")).alias("fingerprint"), "component_id")


def op9_tokencount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_matches(table(spark, sf_dir, "documents"))


def op11_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lloyd.coded(table(spark, sf_dir, "embeddings"))


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op13_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return lm.scored(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


OP4_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages
), g AS (SELECT d, min(page_id) AS f FROM p WHERE n >= 100 GROUP BY d)
SELECT p.page_id, n AS payload_bytes, p.d AS payload_digest,
  CASE WHEN f IS NOT NULL AND p.page_id IS DISTINCT FROM f THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN f IS NOT NULL AND p.page_id IS DISTINCT FROM f THEN f END AS refers_to
FROM p LEFT JOIN g ON p.d = g.d AND p.n >= 100
"""


OP7_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
OP7_SQL = f"""
WITH d AS (SELECT doc_id, {OP7_WORDS} AS w FROM documents), b AS (SELECT item_id, {OP7_WORDS} AS w FROM benchmark),
s AS (SELECT item_id, w, least(len(w), 13) AS n FROM b WHERE len(w) > 0),
v AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM s)),
p AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM v) l WHERE len(w) >= n)),
h AS (SELECT p.doc_id, p.i, p.n, v.item_id FROM p JOIN v ON p.n = v.n AND p.win = v.win),
c AS (SELECT doc_id, count(DISTINCT word) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS word FROM h) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::varchar AS item FROM h) GROUP BY 1)
SELECT d.doc_id, len(w)::bigint AS n_words, coalesce(n_hit, 0)::bigint AS n_hit, coalesce(n_items, 0)::bigint AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""


# points of the schedule through the cumulative targets, ranks in each source, and the blocks that documents lie in
OP3_SQL = f"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint AS size,
    md5(concat_ws('/', 'mix', coalesce(concat('=', doc_id::varchar), '-'), coalesce(md5(text), '-'), coalesce(concat('=', source), '-'))) AS key FROM documents
), s AS (SELECT source, sum(size)::bigint AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source),
r AS (SELECT *, source_size * 2.0::double AS cap, CASE place % 3 WHEN 0 THEN 5.0::double WHEN 1 THEN 2.0::double ELSE 1.0::double END AS weight FROM s),
o AS (SELECT *, cap / weight AS ratio FROM r),
l AS (SELECT *, (1.5::double * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY ratio, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY ratio, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM o),
e AS (SELECT level AS ends FROM l WHERE ratio >= level ORDER BY ratio, place LIMIT 1),
t AS (SELECT source, place, source_size, CASE WHEN ratio < ends THEN cap ELSE least(cap, ends * weight) END AS target FROM l, e),
w AS (SELECT greatest(1, ceil(floor(sum(target)) / 262144))::bigint AS block, ceil(floor(sum(target)) / greatest(1, ceil(floor(sum(target)) / 262144)))::bigint AS points, sum(target) AS total, count(*) AS sources FROM t),
x AS (SELECT t.*, coalesce(sum(target) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / total AS starts, (round(target)::bigint + block - 1) // block AS needed FROM t, w),
v AS (SELECT i, ({' + '.join(f'((i >> {b}) & 1) * {1 << (31 - b)}' for b in range(20))}) / 4294967296.0::double AS point FROM (SELECT unnest(range(points)) AS i FROM w)),
g AS (SELECT i, arg_max(place, (starts, place)) AS place FROM v JOIN x ON starts <= point GROUP BY i),
k AS (SELECT i AS slot, place, row_number() OVER (PARTITION BY place ORDER BY i) - 1 AS rank FROM g),
h AS (SELECT x.place, needed, count(k.place) AS has FROM x LEFT JOIN k USING (place) GROUP BY ALL),
j AS (SELECT row_number() OVER (ORDER BY slot) - 1 AS slot, place, rank FROM (SELECT slot, place, rank FROM k JOIN h USING (place) WHERE rank < needed
  UNION ALL SELECT points + rank * sources + place, place, rank FROM (SELECT place, unnest(range(has, needed)) AS rank FROM h), w)),
b AS (SELECT *, (sum(size) OVER (PARTITION BY source ORDER BY key ROWS UNBOUNDED PRECEDING))::bigint - size AS a FROM d),
m AS (SELECT doc_id, size, key, x.source_size, x.target, x.place, turn, turn * x.source_size + a AS low, greatest(0, least(turn * x.source_size + a + size, round(x.target)::bigint) - (turn * x.source_size + a)) AS words
  FROM b JOIN x ON b.source IS NOT DISTINCT FROM x.source, (SELECT unnest([0, 1]) AS turn)),
n AS (SELECT m.key, min(slot) AS first_slot FROM m JOIN w ON m.words > 0 JOIN j ON m.place = j.place AND j.rank BETWEEN m.low // block AND (m.low + m.words - 1) // block GROUP BY 1)
SELECT doc_id, size, source_size, target, sum(words)::bigint AS taken, any_value(first_slot)::bigint AS first_slot FROM m LEFT JOIN n USING (key) GROUP BY key, doc_id, size, source_size, target
"""


def _op5_sql(levels: int = 4, dimensions: tuple[str, ...] = ("d_size", "d_source", "d_lang", "d_id")) -> str:
    """The tree in SQL: at each level every node is cut at the middle byte of its widest dimension."""
    first_six = "coalesce(('0x' || rpad(left(hex(encode({})), 12), 12, '0'))::bigint::double, -1)"
    width = "(max({0}) OVER n - min({0}) OVER n) / w_{0} AS u_{0}"
    widest = f"greatest({', '.join(f'u_{d}' for d in dimensions)})"
    along = " ".join(f"WHEN u_{d} >= {widest} THEN {d}" for d in dimensions)
    cuts = "".join(
        f""",
u{i} AS (SELECT l{i}.*, sum(size) OVER n AS whole, {', '.join(width.format(d) for d in dimensions)} FROM l{i}, widths WINDOW n AS (PARTITION BY node)),
v{i} AS (SELECT *, CASE {along} END AS value FROM u{i}),
l{i + 1} AS (SELECT * EXCLUDE (whole, value, {', '.join(f'u_{d}' for d in dimensions)}) REPLACE (2 * node + (2 * sum(size) OVER (PARTITION BY node ORDER BY value, tie ROWS UNBOUNDED PRECEDING) - size > whole)::int AS node) FROM v{i})"""
        for i in range(levels)
    )
    return f"""
WITH t AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda a, i: xor(a >> 1, 3988292384 * (a & 1)), n)) AS tab),
d AS (SELECT doc_id, source, lang, octet_length(encode(coalesce(text, ''))) + 1 AS size, xor(list_reduce(list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::bigint),
  lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1]), 4294967295), 4294967295) AS crc FROM documents, t),
l0 AS (SELECT doc_id, size, crc, 0 AS node, ('0x' || left(md5(concat(coalesce(doc_id::varchar, '-'), ':', crc)), 15))::bigint AS tie,
  log2(size) AS d_size, {first_six.format('source')} AS d_source, {first_six.format('lang')} AS d_lang, coalesce(doc_id::double, -1) AS d_id FROM d),
widths AS (SELECT {', '.join(f'coalesce(nullif(max({d}) - min({d}), 0), 1) AS w_{d}' for d in dimensions)} FROM l0){cuts}
SELECT doc_id, size::bigint AS size, crc::bigint AS text_crc32, 'bytes' AS law, node::int AS shard, row_number() OVER (PARTITION BY node ORDER BY tie) - 1 AS slot, NULL::int AS grown_shard FROM l{levels}
"""


def _op8_sql() -> str:
    """XXH64 of every distinct shingle step by step in 128-bit numbers, then all pairs of distinct fingerprints."""
    # fixed values: the five primes of XXH64
    p1, p2, p3, p4, p5 = (f"{p}::uhugeint" for p in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))
    whole = 1 << 64
    low = lambda x: f"(({x}) & {whole - 1}::uhugeint)"
    number = lambda x: f"({x}::ubigint::uhugeint)"
    left = lambda x, by: low(f"(({x}) << {by}) | (({x}) >> {64 - by})")
    times = lambda x, p: low(f"({x}) * {p}")
    turned = lambda acc, x: times(left(low(f"({acc}) + ({x}) * {p2}"), 31), p1)
    folded = lambda acc, x: low(f"xor({acc}, {x}) * {p1} + {p4}")
    # bytes are little-endian: they are read from the reversed text
    read = lambda at, n: number(f"('0x' || substr(back, 2 * (len - ({at}) - {n}) + 1, {2 * n}))")
    lane = lambda k: f"list_reduce(list_transform(range(len // 32), lambda j: {read(f'32 * j + {8 * k}', 8)}), lambda a, x: {turned('a', 'x')}, {number((42 + (11400714785074694791 + 14029467366897019727, 14029467366897019727, 0, -11400714785074694791)[k]) % whole)})"
    merged = low(" + ".join(left(f"v{k}", by) for k, by in enumerate((1, 7, 12, 18))))
    for k in range(4):
        merged = folded(merged, turned("0::uhugeint", f"v{k}"))
    eights = f"list_reduce(list_transform(range(len % 32 // 8), lambda j: {turned('0::uhugeint', read('len // 32 * 32 + 8 * j', 8))}), lambda a, x: {low(left('xor(a, x)', 27) + f' * {p1} + {p4}')}, acc)"
    four = f"CASE WHEN len % 8 >= 4 THEN {low(left(f'xor(acc, {times(read("len // 8 * 8", 4), p1)})', 23) + f' * {p2} + {p3}')} ELSE acc END"
    ones = f"list_reduce(list_transform(range(len % 4), lambda j: {times(read('len // 4 * 4 + j', 1), p5)}), lambda a, x: {times(left('xor(a, x)', 11), p1)}, acc)"
    mixed = lambda by, p: times(f"xor(acc, acc >> {by})", p)
    steps = [eights, four, ones, mixed(33, p2), mixed(29, p3), "xor(acc, acc >> 32)"]
    chain = "".join(f", h{i + 1} AS (SELECT s, len, back, {step} AS acc FROM h{i})" for i, step in enumerate(steps))
    sums = ", ".join(f"count(*) FILTER (acc >> {i} & 1 = 1) AS b{i}" for i in range(64))
    bits = " + ".join(f"CASE WHEN 2 * b{i} > n THEN {1 << i}::uhugeint ELSE 0 END" for i in range(64))
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w, row_number() OVER () AS r FROM documents),
g AS (SELECT r, array_to_string(w[i:i + 2], ' ') AS s FROM (SELECT *, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
e AS (SELECT s, octet_length(encode(s)) AS len, array_to_string(list_reverse(regexp_extract_all(hex(encode(s)), '..')), '') AS back FROM (SELECT DISTINCT s FROM g)),
v AS (SELECT *, {', '.join(f'{lane(k)} AS v{k}' for k in range(4))} FROM e),
h0 AS (SELECT s, len, back, {low(f'CASE WHEN len >= 32 THEN {merged} ELSE 42 + {p5} END + len::uhugeint')} AS acc FROM v){chain},
b AS (SELECT r, count(*) AS n, {sums} FROM g JOIN h{len(steps)} USING (s) GROUP BY r),
f AS (SELECT doc_id, coalesce(fp, 0::uhugeint) AS fp FROM d LEFT JOIN (SELECT r, {bits} AS fp FROM b) USING (r)),
u AS (SELECT fp, min(doc_id) AS first FROM f GROUP BY fp),
near AS (SELECT x.fp AS a, y.fp AS b FROM u x JOIN u y ON x.fp <> y.fp AND bit_count(xor(x.fp, y.fp)::hugeint) <= 2),
way(fp, other) AS (SELECT fp, fp FROM u UNION SELECT way.fp, near.b FROM way JOIN near ON near.a = way.other),
c AS (SELECT way.fp, min(u.first) AS component_id FROM way JOIN u ON u.fp = way.other GROUP BY way.fp)
SELECT doc_id, lower(lpad(hex(fp::ubigint), 16, '0')) AS fingerprint, component_id FROM f JOIN c USING (fp)
"""


def _op11_sql(rounds: int = 6) -> str:
    """Every part against every entry in each round, without trees."""
    steps = ""
    for i in range(rounds + 1):
        steps += f""",
a{i} AS (SELECT vec_id, label, part, p, min((d, idx)) AS best FROM (SELECT x.vec_id, x.label, x.part, x.p, c.idx, list_sum(list_transform(list_zip(x.p, c.p), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint AS d
  FROM parts x JOIN c{i} c ON c.part = x.part) GROUP BY ALL)"""
        if i < rounds:
            steps += f""",
m{i} AS (SELECT part, idx, list(floor(s::double / n)::bigint ORDER BY pos) AS p FROM (SELECT part, best[2] AS idx, pos, sum(v) AS s, count(*) AS n FROM (SELECT part, best, unnest(p) AS v, unnest(range(len(p))) AS pos FROM a{i}) GROUP BY ALL) GROUP BY ALL),
c{i + 1} AS (SELECT part, idx, coalesce(m.p, c.p) AS p FROM c{i} c LEFT JOIN m{i} m USING (part, idx))"""
    return f"""
WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::double)::bigint) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT vec_id, label, part, v[part * len(v) // 8 + 1:(part + 1) * len(v) // 8] AS p FROM (SELECT *, unnest(range(8)) AS part FROM kept)),
c0 AS (SELECT part, dense_rank() OVER (ORDER BY vec_id) - 1 AS idx, p FROM parts QUALIFY idx < 16){steps},
e AS (SELECT vec_id, label, string_agg(lpad(lower(hex(best[2])), 2, '0'), '' ORDER BY part) AS code, sum(best[1])::bigint AS error FROM a{rounds} GROUP BY ALL),
h AS (SELECT sha256(string_agg(array_to_string(p, ','), ',' ORDER BY part, idx)) AS codebooks_sha256 FROM c{rounds})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::bigint AS label_error, codebooks_sha256 FROM e, h
"""


# every prefix of every conversation, by the digests of its turns
OP12_SQL = """
WITH t AS (SELECT conv_id, coalesce(text, '') AS text, md5(concat(octet_length(encode(coalesce(role, '')))::varchar, ':', coalesce(role, ''), coalesce(text, ''))) AS g, turn FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, g, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS w, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, g) AS pos FROM t),
tab AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda a, i: xor(a >> 1, 3988292384 * (a & 1)), n)) AS tab),
c AS (SELECT conv_id, conv_id - conv_id % 20 AS family, xor(list_reduce(list_transform(regexp_extract_all(conv_id::varchar, '.'), lambda x: ascii(x)::bigint), lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1]), 4294967295), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM o), tab),
r AS (SELECT c.conv_id, o.g, o.w, o.pos AS k FROM c JOIN o ON o.conv_id = c.family AND o.pos <= c.h UNION ALL SELECT c.conv_id, o.g, o.w, o.pos FROM c JOIN o ON o.conv_id = c.conv_id AND o.pos > c.h),
q AS (SELECT conv_id, g, w, row_number() OVER (PARTITION BY conv_id ORDER BY k) AS depth FROM r),
p AS (SELECT conv_id, depth, w, string_agg(g, '') OVER (PARTITION BY conv_id ORDER BY depth) AS path FROM q UNION ALL SELECT conv_id, 0, 0, '' FROM c),
l AS (SELECT conv_id, max(depth) AS last FROM p GROUP BY 1),
n AS (SELECT path, depth, min(p.conv_id) AS conv_id, count(*) AS n_convs, max(w) AS w, sha256(coalesce(string_agg(p.conv_id::varchar, ',' ORDER BY p.conv_id) FILTER (depth = last), '')) AS ends_sha256 FROM p JOIN l USING (conv_id) GROUP BY 1, 2),
k AS (SELECT path[:-33] AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
a AS (SELECT path, unnest(list_transform(range(depth + 1), lambda i: path[:32 * i])) AS top, (n_convs - 1) * w AS saved, (n_children IS NULL)::int AS leaf FROM n LEFT JOIN k USING (path)),
s AS (SELECT top AS path, sum(saved) AS saved_tokens, sum(leaf) AS n_leaves FROM a GROUP BY 1)
SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0)::bigint AS n_children, n_leaves::bigint AS n_leaves, saved_tokens::bigint AS saved_tokens, n.ends_sha256
FROM n JOIN s USING (path) LEFT JOIN k USING (path) LEFT JOIN n u ON n.depth > 0 AND u.path = n.path[:-33]
"""


def oracle_sql() -> dict:
    return {"op3_mixing": OP3_SQL, "op4_warc": OP4_SQL, "op5_sharding": _op5_sql(), "op7_decontamination": OP7_SQL, "op8_simhash": _op8_sql(), "op11_lloyd": _op11_sql(), "op12_trie": OP12_SQL}
