"""The registered queries of the corpus operators, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curio.llm import decontaminate, fim, maglev, media, mixing, packing, quality, rules, runindex, simhash, superkmer, toxicity, whiten
from curio.llm.common import table

SHARDS = [f"shard-{i:02d}" for i in range(32)]


def op1_iso_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stored in an ISO media container and described from it."""
    return media.probe(media.store_texts(table(spark, sf_dir, "documents")))


def op2_maglev_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every document."""
    return maglev.assign(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", SHARDS)


def op3_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprint and the near-duplicate component of every document."""
    return simhash.hamming_groups(table(spark, sf_dir, "documents"), simhash.exact_plan())


def op4_run_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without strings of 200 bytes that occur elsewhere."""
    return runindex.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op5_systematic_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select(
        "doc_id", "size", F.col("source_size").cast("long").alias("source_size"), F.round("target", 6).alias("target"), (F.col("copies") * F.col("size")).alias("taken")
    )


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in a sequence."""
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document."""
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The expected grade of every document, from three grades: low quality, good but toxic, good."""
    docs = table(spark, sf_dir, "documents")
    rated = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2)
    ratings = table(spark, sf_dir, "labels").where("quality is not null and toxic is not null").select("doc_id", rated.alias("grade"))
    return quality.grade(docs, quality.fit(docs, ratings))


def op9_adaptive_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict of the quality rules on every document."""
    judged = rules.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_super_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without windows of 20 words that occurred before."""
    return superkmer.remove_repeats(table(spark, sf_dir, "documents")).drop("kept_text")


def op11_ngram_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of every document that stand in the benchmark."""
    found = decontaminate.decontaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut and arranged, and its text rebuilt from the output."""
    both = fim.undo(fim.render(fim.describe(table(spark, sf_dir, "documents"))))
    return fim.hashed(both, {"pieces": "output_sha256", "restoring": "restored_sha256"}, keep=["doc_id", "n", "form", "prefix_chars", "middle_chars"])


def op13_cholesky_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whitened components of every embedding."""
    return whiten.components(table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_iso_media, op2_maglev_shards, op3_simhash_groups, op4_run_index, op5_systematic_mix, op6_best_fit_packing, op7_toxicity, op8_ordinal_quality, op9_adaptive_rules, op10_super_kmers,
        op11_ngram_decontamination, op12_fill_in_middle, op13_cholesky_whitening,
    )
}

_DOCS = r"docs AS MATERIALIZED (SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents)"

OP2_SQL = """
WITH RECURSIVE shards AS (SELECT i, 'shard-' || lpad(i::VARCHAR, 2, '0') AS name FROM range(0, 32) AS r(i)),
preferences AS (SELECT list(name ORDER BY i) AS names, list(('0x' || md5(name || '/offset')[1:8])::BIGINT % 3209 ORDER BY i) AS first,
  list(('0x' || md5(name || '/skip')[1:8])::BIGINT % 3208 + 1 ORDER BY i) AS skip FROM shards),
claims AS (SELECT -1::BIGINT AS turn, -1::BIGINT AS slot, bitstring('0', 3209) AS taken UNION ALL
  SELECT turn, slot, set_bit(taken, slot::INTEGER, 1) FROM (SELECT turn + 1 AS turn, taken,
    list_filter(list_transform(range(0, 3209), lambda j: (first[(turn + 1) % 32 + 1] + j * skip[(turn + 1) % 32 + 1]) % 3209), lambda s: get_bit(taken, s::INTEGER) = 0)[1] AS slot
  FROM claims, preferences WHERE turn < 3208)),
placed AS (SELECT doc_id, ('0x' || md5(coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT % 3209 AS slot FROM documents)
SELECT d.doc_id, d.slot, p.names[c.turn % 32 + 1] AS shard FROM placed d JOIN claims c ON c.slot = d.slot, preferences p
"""

OP4_SQL = """
WITH docs AS MATERIALIZED (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
starts AS (SELECT doc_id, unnest(range(1, octet_length(b) - 198)) AS i, b FROM docs WHERE octet_length(b) >= 200),
hashed AS (SELECT doc_id, i, md5_number(b[i:i + 199]) AS h FROM starts),
again AS (SELECT doc_id, i FROM hashed WHERE h IN (SELECT h FROM hashed GROUP BY h HAVING count(*) > 1)),
islands AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM
  (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200 THEN 0 ELSE 1 END AS fresh FROM again)),
spans AS (SELECT doc_id, min(i) AS a, max(i) + 200 AS z FROM islands GROUP BY doc_id, island),
gaps AS (SELECT doc_id, list(a ORDER BY a) AS a, list(z ORDER BY a) AS z, sum(z - a) AS gone, count(*) AS n FROM spans GROUP BY doc_id)
SELECT d.doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(n, 0)::BIGINT AS n_spans,
  sha256(CASE WHEN n IS NULL THEN b ELSE list_reduce(list_transform(range(0, n + 1), lambda k: b[(CASE WHEN k = 0 THEN 1 ELSE z[k] END):(CASE WHEN k = n THEN octet_length(b) ELSE a[k + 1] - 1 END)]), lambda x, y: x || y) END) AS kept_sha256
FROM docs d LEFT JOIN gaps g ON g.doc_id = d.doc_id
"""

OP5_SQL = rf"""
WITH {_DOCS}, sized AS (SELECT doc_id, source, len(w)::BIGINT AS size, ('0x' || md5('mix-1:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT AS h FROM docs),
own AS (SELECT source, sum(size)::DOUBLE AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, ([5.0, 2.0, 1.0])[((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INTEGER]::DOUBLE AS weight, sum(source_size) OVER () * 1.5 AS total FROM own),
capped AS (SELECT *, 2.0 * source_size AS cap, 2.0 * source_size / weight AS ratio FROM ranked),
filled AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY ratio, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY ratio, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM capped),
goals AS (SELECT source, source_size, least(cap, weight * (SELECT level FROM filled WHERE ratio >= level ORDER BY ratio, level DESC LIMIT 1)) AS target,
  ('0x' || md5('mix-1:source:' || coalesce(source, ''))[1:8])::BIGINT / 4294967296.0::DOUBLE AS shift FROM filled),
placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY floor(ln(size + 1.0) / ln(2.0) * 4), h % 512, size, h, doc_id) AS nth FROM sized),
mixed AS (SELECT p.doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate, shift, nth FROM placed p JOIN goals g ON p.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size::BIGINT AS source_size, round(target, 6) AS target, ((floor(nth * rate + shift) - floor((nth - 1) * rate + shift)) * size)::BIGINT AS taken FROM mixed
"""

OP9_SQL = rf"""
WITH {_DOCS}, starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM docs WHERE len(w) >= 8),
windows AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(w[i:i + 7], ' ')) AS c FROM starts),
repeated AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM windows, range(0, 8) AS r(j) WHERE c > 1 GROUP BY doc_id),
measured AS (SELECT d.doc_id, lang, source, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, length(regexp_replace(text, '[^A-Z]', '', 'g'))::BIGINT AS n_upper,
  (len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))))::BIGINT AS n_dup_lines,
  coalesce(r.n, 0)::BIGINT AS n_repeat_words FROM docs d LEFT JOIN repeated r ON r.doc_id = d.doc_id),
based AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM measured),
binned AS (SELECT doc_id, lang, source, base_failed, unnest(range(0, 5)) AS m, unnest([CASE WHEN word_chars > 0 THEN floor(n_symbols * 1000 / word_chars) ELSE 0 END, CASE WHEN n_words > 0 THEN floor(n_repeat_words * 1000 / n_words) ELSE 0 END,
  CASE WHEN n_words > 0 THEN floor(n_dup_lines * 1000 / n_words) ELSE 0 END, CASE WHEN word_chars > 0 THEN floor(n_upper * 1000 / word_chars) ELSE 0 END, CASE WHEN n_words > 0 THEN floor(word_chars * 100 / n_words) ELSE 0 END])::BIGINT AS bin,
  unnest([10, 60, 20, 60, 150]) AS least FROM based),
good AS (SELECT * REPLACE ((bin >> greatest(length(bin(bin)) - 10, 0)) << greatest(length(bin(bin)) - 10, 0) AS bin) FROM binned WHERE NOT base_failed),
quartiles AS (SELECT 0 AS level, lang, source, m, any_value(least) AS least, count(*) AS n, quantile_disc(bin, 0.25) AS low, quantile_disc(bin, 0.75) AS high FROM good GROUP BY lang, source, m
  UNION ALL SELECT 1, lang, NULL, m, any_value(least), count(*), quantile_disc(bin, 0.25), quantile_disc(bin, 0.75) FROM good GROUP BY lang, m
  UNION ALL SELECT 2, NULL, NULL, m, any_value(least), count(*), quantile_disc(bin, 0.25), quantile_disc(bin, 0.75) FROM good GROUP BY m),
fences AS (SELECT *, high + 3.0::DOUBLE * greatest(high - low, least) AS fence FROM quartiles),
wider AS (SELECT f1.lang, f1.m, (f1.n * f1.fence + 10 * f2.fence) / (f1.n + 10) AS fence FROM fences f1 JOIN fences f2 ON f1.level = 1 AND f2.level = 2 AND f1.m = f2.m),
own AS (SELECT f0.lang, f0.source, f0.m, (f0.n * f0.fence + 10 * w.fence) / (f0.n + 10) AS fence FROM fences f0 JOIN wider w ON f0.level = 0 AND f0.m = w.m AND f0.lang IS NOT DISTINCT FROM w.lang),
over AS (SELECT b.doc_id, coalesce(bool_or(b.bin > o.fence), false) AS beyond FROM binned b
  LEFT JOIN own o ON o.m = b.m AND o.lang IS NOT DISTINCT FROM b.lang AND o.source IS NOT DISTINCT FROM b.source GROUP BY b.doc_id)
SELECT a.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT beyond AS kept FROM based a JOIN over o ON o.doc_id = a.doc_id
"""

OP10_SQL = rf"""
WITH {_DOCS}, starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM docs WHERE len(w) >= 20),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(w[i:i + 19], ' ') ORDER BY doc_id, i) AS r FROM starts) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM later, range(0, 20) AS r(j)),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM docs),
kept AS (SELECT words.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY words.p) AS k FROM words LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.p = words.p WHERE gone.p IS NULL GROUP BY words.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(k, '')) AS kept_sha256 FROM docs d LEFT JOIN kept ON kept.doc_id = d.doc_id
"""

OP11_SQL = r"""
WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
wanted AS MATERIALIZED (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i + 1:i + 10], ' ') AS k FROM (SELECT item_id, w, unnest(range(0, greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0)),
starts AS (SELECT doc_id, w, n, unnest(range(0, len(w) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM wanted) WHERE len(w) >= n),
found AS MATERIALIZED (SELECT s.doc_id, s.i, s.n, t.item_id FROM (SELECT doc_id, i, n, array_to_string(w[i + 1:i + n], ' ') AS k FROM starts) s JOIN wanted t ON s.k = t.k AND s.n = t.n),
hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM found)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS k FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(i.n, 0)::BIGINT AS n_items, sha256(coalesce(i.k, '')) AS items_sha256, h.n IS NOT NULL AS contaminated
FROM d LEFT JOIN hit h ON h.doc_id = d.doc_id LEFT JOIN items i ON i.doc_id = d.doc_id
"""

OP12_SQL = """
WITH drawn AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || doc_id) AS h FROM documents),
told AS (SELECT doc_id, t, length(t)::BIGINT AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM drawn),
cut AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS z,
  CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM told),
parts AS (SELECT *, substring(t, 1, a) AS p, substring(t, a + 1, z - a) AS m, substring(t, z + 1, n - z) AS s FROM cut),
made AS (SELECT *, CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE t END AS o FROM parts),
placed AS (SELECT *, strpos(o, '<P>') AS ip, strpos(o, '<S>') AS i_s, strpos(o, '<M>') AS im FROM made)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN z - a END AS middle_chars, sha256(o) AS output_sha256,
  sha256(CASE form WHEN 'psm' THEN substring(o, ip + 3, i_s - ip - 3) || substring(o, im + 3) || substring(o, i_s + 3, im - i_s - 3)
    WHEN 'spm' THEN substring(o, ip + 3, im - ip - 3) || substring(o, im + 3) || substring(o, i_s + 3, ip - i_s - 3) ELSE o END) AS restored_sha256 FROM placed
"""

#: For ids that differ and aren't null, as the tables have them.
ORACLES: dict[str, str] = {"op2_maglev_shards": OP2_SQL, "op4_run_index": OP4_SQL, "op5_systematic_mix": OP5_SQL, "op9_adaptive_rules": OP9_SQL, "op10_super_kmers": OP10_SQL, "op11_ngram_decontamination": OP11_SQL, "op12_fill_in_middle": OP12_SQL}
