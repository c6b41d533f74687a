"""The queries of the operators, each over its whole table, and their SQL where DuckDB can express it.

DuckDB has no CRC-32, XXH64 or SHA of decoded films, and no classifiers, trees or BPE, so only the mix has SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, html_extract, iblt, langid, media, mixing, quality, sharding, simhash, toxicity
from .common import batches, ship, table

Query = Callable[[SparkSession, str], DataFrame]


def _on(name: str, f: Callable[..., DataFrame], *more: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        batches(spark)
        return f(table(spark, sf_dir, name), *(table(spark, sf_dir, m) for m in more))

    return run


def queries() -> dict[str, Query]:
    return {
        "op1_sharding": _on("documents", lambda d: sharding.shard(d).drop("row_number")),
        "op2_mixing": _on("documents", lambda d: mixing.mix(d).select("doc_id", "size", "source_size", "target", "taken")),
        "op3_html": _on("pages", html_extract.main_text),
        "op4_language": _on("documents", langid.identify),
        "op5_toxicity": _on("documents", toxicity.classify, "labels"),
        "op6_bpe": _on("documents", lambda d: bpe.encode(d, digests=True)),
        "op7_fingerprint": _on("documents", iblt.compare),
        "op8_simhash": _on("documents", simhash.near_duplicates),
        "op9_quality": _on("documents", quality.classify, "labels"),
        "op10_media": _on("documents", lambda d: media.films(d, media=False)),
    }


def _fill(before: str, after: str) -> str:
    """One filling of the words still missing in the stretch of ranks at the boundary."""
    return f"""
{after}_a AS (SELECT *, CASE WHEN extra = 0 AND size <= gap THEN size ELSE 0 END AS fits FROM {before}),
{after}_b AS (SELECT *, sum(fits) OVER (PARTITION BY source ORDER BY odds, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto FROM {after}_a),
{after}_c AS (SELECT *, fits > 0 AND upto <= gap AS now FROM {after}_b),
{after} AS (SELECT doc_id, source, size, source_size, target, whole, odds, CASE WHEN now THEN 1 ELSE extra END AS extra,
  gap - coalesce(max(CASE WHEN now THEN upto END) OVER (PARTITION BY source), 0) AS gap FROM {after}_c)"""


MIXING_SQL = (
    r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n, sum(length(bin(size)) * size)::DOUBLE AS bit_words FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3::DOUBLE WHEN 1 THEN 1::DOUBLE ELSE 2::DOUBLE END AS weight,
  2::DOUBLE * source_size AS cap FROM s),
l AS (SELECT *, (1.5::DOUBLE * (sum(source_size::DOUBLE) OVER ())
  - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT *, CASE WHEN cap <= level * weight THEN cap ELSE (max(CASE WHEN cap > level * weight THEN level END) OVER ()) * weight END AS target FROM l),
r AS (SELECT d.doc_id, d.source, d.size, source_size, bit_words, target, greatest(1, n // 1000) AS buckets,
  CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole,
  (('0x' || substr(md5(coalesce(d.doc_id::VARCHAR, '') || ':7'), 1, 13))::BIGINT::DOUBLE + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
m AS (SELECT *, CASE WHEN source_size > 0 THEN target ELSE 0 END - whole * source_size::DOUBLE AS missing FROM r),
c AS (SELECT *, least(0.98::DOUBLE, missing * length(bin(size)) / bit_words) AS chance FROM m),
o AS (SELECT *, CASE WHEN chance > 0 THEN (u / (1 - u)) / (chance / (1 - chance)) END AS odds FROM c),
p AS (SELECT *, CASE WHEN odds IS NOT NULL AND size > 0 THEN floor(odds / (1 + odds) * buckets)::BIGINT END AS bucket FROM o),
b AS (SELECT source, bucket, missing, sum(size) AS words FROM p WHERE bucket IS NOT NULL GROUP BY ALL),
x AS (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY bucket) AS upto FROM b),
e AS (SELECT source, min(bucket) AS edge, min_by(upto - words, bucket) AS before FROM x WHERE upto > missing GROUP BY source),
q AS (SELECT p.*, e.edge, e.before FROM p LEFT JOIN e ON p.source IS NOT DISTINCT FROM e.source),
f0 AS (SELECT doc_id, source, size, source_size, target, whole, odds, 0 AS extra, missing - before AS gap FROM q WHERE bucket = edge),"""
    + ",".join(_fill(f"f{i}", f"f{i + 1}") for i in range(1 + mixing.FILLS))
    + f""",
every AS (SELECT doc_id, size, source_size, target, whole, extra FROM f{1 + mixing.FILLS} UNION ALL
  SELECT doc_id, size, source_size, target, whole, CASE WHEN bucket IS NOT NULL AND (edge IS NULL OR bucket < edge) THEN 1 ELSE 0 END
  FROM q WHERE bucket IS NULL OR edge IS NULL OR bucket <> edge)
SELECT doc_id, size, source_size, target, ((whole + extra) * size)::BIGINT AS taken FROM every
"""
)


def oracle_sql() -> dict[str, str]:
    return {"op2_mixing": MIXING_SQL}
