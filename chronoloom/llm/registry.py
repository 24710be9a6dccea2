"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import fit, judge

    docs = _table(spark, sf_dir, "documents")
    judged = judge(docs, fit(docs, _table(spark, sf_dir, "labels")))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contamination

    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .tokenfiles import read_token_files, write_token_files

    files = write_token_files(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return read_token_files(spark, files)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op6_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm import score

    return score(_table(spark, sf_dir, "documents"))


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html import extract

    return extract(_table(spark, sf_dir, "pages"))


def op8_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents come in, counted by one tokenizer; those in German go, those of src0 are
    counted anew by another one, which then counts all; one batch is delivered twice."""
    import public_tokenizers

    from .rollup import Rollup, token_counts
    from .store import materialize, new_path

    tokenizers = {"first": (public_tokenizers.path("byte_bpe_50k.json"), None), "second": (public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)}
    counted = materialize(token_counts(_table(spark, sf_dir, "documents"), tokenizers), "token-counts")

    def changes(rows: DataFrame, change: str, version: str, now: str, old: str | None = None) -> DataFrame:
        before = F.col(old) if old else F.lit(None).cast("long")
        return rows.select("source", "lang", F.lit(version).alias("tokenizer_version"), F.lit(change).alias("change"), F.col(now).alias("n_tokens"), before.alias("old_tokens"))

    rollup = Rollup(spark, new_path(spark, "token-rollup"))
    arrived = changes(counted, "insert", "byte-bpe", "first")
    rollup.commit("arrived", arrived)
    rollup.commit("withdrawn", changes(counted.where("lang = 'de'"), "delete", "byte-bpe", "first"))
    rollup.commit("arrived", arrived)
    rollup.commit("recounted", changes(counted.where("source = 'src0' and lang is distinct from 'de'"), "revise", "byte-bpe", "second", "first"))
    rollup.commit("second-tokenizer", changes(counted, "insert", "byte-bpe-multi", "second"))
    return rollup.totals()


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import digest, scan

    return digest(scan(_table(spark, sf_dir, "documents")))


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substrings import remove_repeats

    return remove_repeats(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .collocations import collocations

    return collocations(_table(spark, sf_dir, "documents"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh or so document, by the checksum of its doc_id, is claimed to have one character more."""
    from .merkle import manifest

    more = (F.col("n_chars").cast("decimal(38,0)") + 1).cast("string")
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    claims = {"n_chars": F.when(tampered, more).otherwise(F.col("n_chars").cast("string"))}
    return manifest(_table(spark, sf_dir, "documents"), claims).verified()


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit, score

    docs = _table(spark, sf_dir, "documents")
    return score(docs, fit(docs, _table(spark, sf_dir, "labels")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mixing": op1_mixing,
        "op2_quality": op2_quality,
        "op3_decontamination": op3_decontamination,
        "op4_token_files": op4_token_files,
        "op5_simhash": op5_simhash,
        "op6_language_model": op6_language_model,
        "op7_html": op7_html,
        "op8_token_rollup": op8_token_rollup,
        "op9_secrets": op9_secrets,
        "op10_substrings": op10_substrings,
        "op11_collocations": op11_collocations,
        "op12_merkle": op12_merkle,
        "op13_toxicity": op13_toxicity,
    }


def _op1_sql() -> str:
    """Quotients ranked one by one, and blocks taken in the order of their ranks."""
    from .mixing import PRIMES

    def number(*parts: str) -> str:
        text = " || '|' || ".join(["'42'", *[f"coalesce({p}::VARCHAR, '')" for p in parts]])
        return f"('0x' || md5({text})[1:15])::BIGINT"

    return rf"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size, {number("doc_id", "text")} AS key FROM documents),
n AS (SELECT count(*) AS n_rows, sum(size) AS n_words, ceil(sqrt(count(*)))::BIGINT AS pieces FROM d),
own AS (SELECT source, sum(size)::BIGINT AS source_size, least(any_value(pieces), greatest(ceil(count(*) * any_value(pieces) / any_value(n_rows)), ceil(sum(size) * any_value(pieces) / any_value(n_words)))) AS own, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM d, n GROUP BY source),
placed AS (SELECT d.*, source_size, floor(key % pieces * own / pieces)::BIGINT AS shard FROM d JOIN own ON d.source IS NOT DISTINCT FROM own.source, n),
weighed AS (SELECT source, source_size, ((place - 1) % 3 + 1)::DOUBLE AS weight, 3.0::DOUBLE * source_size AS cap FROM own),
levels AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level FROM weighed WINDOW b AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
aims AS (SELECT source, source_size, CASE WHEN cap / weight <= max(level) OVER () THEN cap ELSE weight * max(level) OVER () END AS target FROM levels),
seats AS (SELECT round(sum(target) / 16)::BIGINT AS seats FROM aims),
won AS (SELECT source, count(*) AS quota FROM (SELECT source, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, source NULLS LAST) AS place, seats FROM aims, seats, unnest(range(0, seats)) t(k) WHERE target > 0) WHERE place <= seats GROUP BY source),
shards AS (SELECT p.source, shard, sum(size)::BIGINT AS total, coalesce(any_value(quota), 0) AS seats FROM placed p LEFT JOIN won ON won.source IS NOT DISTINCT FROM p.source GROUP BY p.source, shard),
given AS (SELECT source, shard, count(*) AS quota FROM (SELECT source, shard, row_number() OVER (PARTITION BY source ORDER BY total / (2 * k + 1) DESC, shard) AS place, seats FROM shards, unnest(range(0, seats)) t(k) WHERE total > 0) WHERE place <= seats GROUP BY source, shard),
rings AS (
  SELECT s.source, s.shard, total, least(coalesce(quota, 0) * 16, total * 3) AS words, greatest(1, ceil(total / 16))::BIGINT AS blocks, {number("s.source", "s.shard")} AS seed
  FROM shards s LEFT JOIN given g ON g.source IS NOT DISTINCT FROM s.source AND g.shard = s.shard),
ranks AS (
  SELECT source, shard, total, j * 16 AS lo, least(total, j * 16 + 16) AS hi, words // total AS turns, words % total AS rest, (j * ({list(PRIMES)})[seed % {len(PRIMES)} + 1] + seed % blocks) % blocks AS rank
  FROM rings, unnest(range(0, blocks)) t(j) WHERE total > 0),
chosen AS (SELECT *, greatest(0, least(hi - lo, rest - (sum(hi - lo) OVER (PARTITION BY source, shard ORDER BY rank) - (hi - lo)))) AS take FROM ranks),
laid AS (SELECT *, sum(size) OVER (PARTITION BY source, shard ORDER BY key, doc_id NULLS LAST, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS place, row_number() OVER () AS id FROM placed),
parts AS (
  SELECT id, sum(greatest(0, least(lo + take, place + size) - greatest(lo, place)) + greatest(0, least(hi, place + size) - greatest(lo, place)) * turns) AS taken
  FROM laid l JOIN chosen c ON c.source IS NOT DISTINCT FROM l.source AND c.shard = l.shard AND lo < place + size AND hi > place GROUP BY id)
SELECT doc_id, size, l.source_size, target, coalesce(taken, 0)::BIGINT AS taken, l.source FROM laid l LEFT JOIN parts USING (id) JOIN aims a ON a.source IS NOT DISTINCT FROM l.source
"""


# words of documents and items; translate lower-cases A-Z only
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_OP3 = f"""
WITH d AS (SELECT doc_id, {_ALNUM} AS w FROM documents),
b AS (SELECT item_id, {_ALNUM} AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i + 1:i + 10], ' ') AS s FROM b, unnest(range(0, greatest(1, len(w) - 9))) t(i) WHERE len(w) > 0),
hits AS (
  SELECT DISTINCT doc_id, i, n, item_id FROM (
    SELECT doc_id, i, n, array_to_string(w[i + 1:i + n], ' ') AS s FROM d, (SELECT DISTINCT n FROM windows) l, unnest(range(0, len(w) - n + 1)) t(i) WHERE len(w) >= n) x JOIN windows USING (n, s)),
positions AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR)) AS h FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(h, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN positions USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def _op9_sql() -> str:
    """Spans from the lengths of the pieces between matches and of the matches."""
    from .secrets import BASE_RULES, MORE_RULES

    rules, parts = BASE_RULES + MORE_RULES, []
    for n, rule in enumerate(rules):
        pattern = rule.pattern.replace("'", "''")
        parts.append(
            f"SELECT doc_id, {n} AS rule, '{rule.kind}' AS kind, start, start + len(m[i]) AS stop FROM (SELECT doc_id, i, m, g, (list_sum(list_transform(p[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: len(x))), 0))::BIGINT AS start "
            f"FROM (SELECT doc_id, string_split_regex(text, '{pattern}') AS p, regexp_extract_all(text, '{pattern}') AS m, regexp_extract_all(text, '{pattern}', {rule.group}) AS g FROM documents WHERE regexp_matches(text, '{pattern}')), unnest(range(1, len(m) + 1)) t(i)) WHERE len(g[i]) >= {rule.least}"
        )
    counts = ", ".join(f"count(*) FILTER (WHERE rule = {n}) AS n_{rule.kind}" for n, rule in enumerate(BASE_RULES))
    written = "string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rule)"
    return f"""
WITH spans AS ({" UNION ALL ".join(parts)}),
summed AS (SELECT doc_id, {counts}, {written} FILTER (WHERE rule < {len(BASE_RULES)}) AS base, {written} AS spans FROM spans GROUP BY doc_id)
SELECT doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in BASE_RULES)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM documents LEFT JOIN summed USING (doc_id)
"""


_OP10 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (SELECT doc_id, i, array_to_string(w[i + 1:i + 20], ' ') AS s FROM d, unnest(range(0, len(w) - 19)) t(i) WHERE len(w) >= 20),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS n FROM starts) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 20)) AS p FROM later)),
words AS (SELECT doc_id, p, w[p + 1] AS word FROM d, unnest(range(0, len(w))) t(p)),
kept AS (SELECT words.doc_id, string_agg(word, ' ' ORDER BY words.p) AS s FROM words ANTI JOIN gone ON gone.doc_id = words.doc_id AND gone.p = words.p GROUP BY words.doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) g USING (doc_id)
"""


_OP11 = rf"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY lang),
grams AS (SELECT lang, unnest(flatten(list_transform([1, 2, 3, 4], lambda k: list_transform(range(1, len(w) + 2 - k), lambda i: array_to_string(w[i:i + k - 1], ' '))))) AS phrase FROM p),
f AS (SELECT lang, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 30),
split AS (SELECT lang, phrase, f, string_split(phrase, ' ') AS w, len(w) AS k FROM f),
cut AS (SELECT lang, phrase, f, j, array_to_string(w[1:j], ' ') AS lp, array_to_string(w[j + 1:], ' ') AS rp FROM (SELECT *, unnest(range(1, k)) AS j FROM split)),
cuts AS (SELECT c.lang, c.phrase, c.f AS a, x.f AS l, y.f AS r, 2000000::HUGEINT * c.f // (x.f + y.f) AS score, j FROM cut c JOIN f x ON x.lang = c.lang AND x.phrase = lp JOIN f y ON y.lang = c.lang AND y.phrase = rp),
best AS (SELECT lang, phrase, a, l, r, score FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS place FROM cuts) WHERE place = 1),
inner_ AS (SELECT lang, phrase, max(f) AS longer FROM (SELECT lang, f, unnest(flatten(list_transform([2, 3], lambda m: list_transform(range(1, k + 2 - m), lambda i: CASE WHEN m < k THEN array_to_string(w[i:i + m - 1], ' ') END)))) AS phrase FROM split WHERE k > 2) GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN inner_ USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 80 * a)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept) JOIN totals USING (lang) WHERE rank <= 2000
"""

# crc32 bit by bit; levels of trees as rows of a recursion, paths as joins with the levels
_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda r, i: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END)), 4294967295)"


def _op12_sql() -> str:
    def leaf(n_chars: str) -> str:
        fields = ["doc_id::VARCHAR", "source", "lang", n_chars, "text"]
        return "sha256(" + " || ".join(f"coalesce(strlen({f}) || ':' || {f}, '-')" for f in fields) + ")"

    def tree(name: str, rows: str) -> str:
        """Nodes (tree, level, i, n, h) of the leaves (tree, 0, i, n, h) in rows."""
        return f"""{name} AS (SELECT tree, 0 AS level, i, n, h FROM {rows} UNION ALL
  SELECT any_value(tree), any_value(level) + 1, i // 2, (any_value(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM {name} WHERE n > 1 GROUP BY tree, i // 2)"""

    return f"""
WITH RECURSIVE leaves AS (SELECT doc_id, coalesce('=' || lang, '') AS tree, {leaf("n_chars::VARCHAR")} AS h, {leaf(f"(n_chars + ({_CRC} % 7 = 0)::INT)::VARCHAR")} AS claim FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n FROM leaves),
{tree("nodes", "placed")},
roots AS (SELECT tree AS name, '' AS tree, h, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE n = 1),
{tree("uppers", "roots")},
steps AS (
  SELECT doc_id, s.level, s.h, CASE WHEN s.h IS NULL THEN 0 WHEN s.i % 2 = 0 THEN 1 ELSE 2 END AS side FROM (
    SELECT p.doc_id, a.level, b.h, b.i FROM placed p JOIN nodes a ON a.tree = p.tree AND a.i = p.i >> a.level AND a.n > 1 LEFT JOIN nodes b ON b.tree = a.tree AND b.level = a.level AND b.i = xor(a.i, 1)
    UNION ALL
    SELECT p.doc_id, 1000 + a.level, b.h, b.i FROM placed p JOIN roots r ON r.name = p.tree JOIN uppers a ON a.i = r.i >> a.level AND a.n > 1 LEFT JOIN uppers b ON b.level = a.level AND b.i = xor(a.i, 1)) s),
proofs AS (SELECT doc_id, list(struct_pack(side := side, h := coalesce(h, '')) ORDER BY level) AS path, sha256(coalesce(string_agg(h, '' ORDER BY level), '')) AS proof FROM steps GROUP BY doc_id),
folds AS (SELECT p.doc_id, p.claim AS h, 0 AS done, coalesce(f.path, []) AS path FROM placed p LEFT JOIN proofs f USING (doc_id) UNION ALL
  SELECT doc_id, sha256(CASE path[done + 1].side WHEN 1 THEN path[done + 1].h || h WHEN 2 THEN h || path[done + 1].h ELSE h END), done + 1, path FROM folds WHERE done < len(path))
SELECT p.doc_id, p.h AS leaf, r.h AS subroot, u.h AS root, coalesce(f.proof, sha256('')) AS proof_sha256, x.h AS folded_root, x.h = u.h AS verified
FROM placed p JOIN roots r ON r.name = p.tree JOIN uppers u ON u.n = 1 LEFT JOIN proofs f USING (doc_id) JOIN folds x ON x.doc_id = p.doc_id AND x.done = len(x.path)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_mixing": _op1_sql(), "op3_decontamination": _OP3, "op9_secrets": _op9_sql(), "op10_substrings": _OP10, "op11_collocations": _OP11, "op12_merkle": _op12_sql()}
