"""Queries over the gazetteer, feature and tag tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.functions.tiles import tile_name
from tilewright.operators import lines, nearby, packed, skew, wide
from tilewright.session import table

#: A key is hot with this share of all rows.
HOT = 0.05
TILE_ZOOM = 4
NEAR_M = 250.0


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    near = p2_near(spark, d).select(F.lit("near").alias("kind"), "id_a", "id_b")
    return near.unionByName(p2_in(spark, d).select(F.lit("in").alias("kind"), "id_a", "id_b"))


def _points(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "gn_excerpt")
    return g.select(F.col("geonameid").alias("id"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))


def p2_near(spark: SparkSession, d: str) -> DataFrame:
    return nearby.near_pairs(_points(spark, d), NEAR_M)


def p2_in(spark: SparkSession, d: str) -> DataFrame:
    polygons = table(spark, d, "features").where("geom.typ = 3").select(F.col("feature_id").alias("region"), F.col("geom.rings").alias("rings"))
    return nearby.containing_regions(_points(spark, d), polygons).select(F.col("id").alias("id_a"), F.col("region").alias("id_b"))


def first_tile(zoom: int = TILE_ZOOM) -> Column:
    """Tile of the first vertex of the first ring; null without one."""
    v = F.get(F.get(F.col("geom.rings"), F.lit(0)), F.lit(0))
    return tile_name(v["x"], v["y"], zoom)


def _per_key(spark: SparkSession, rows: DataFrame, field: str) -> DataFrame:
    """``field, key, n, share`` for every key that is not null; share of all rows."""
    heavy = skew.bounded(spark, skew.heavy_keys(rows, "key", 0.01))
    counts = skew.aggregate_by_key(rows, "key", [F.count(F.lit(1)).alias("n")], [F.sum("n").alias("n")], heavy)
    total = rows.agg(F.count(F.lit(1)).alias("n"))
    counts = counts.where(F.col("key").isNotNull())
    return counts.select(F.lit(field).alias("field"), "key", "n", (F.col("n") / total.scalar()).alias("share"))


def p4_keys(spark: SparkSession, d: str) -> DataFrame:
    """Rows and share of every country and every tile."""
    countries = table(spark, d, "gn_excerpt").select(F.col("country").alias("key"), "row_id")
    tiles = table(spark, d, "features").select(first_tile().alias("key"), "feature_id")
    return _per_key(spark, countries, "country").unionByName(_per_key(spark, tiles, "tile"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_keys(spark, d).where(F.col("share") >= HOT).select("field", F.col("key").alias("hot_key"))


def p4_country_rows(spark: SparkSession, d: str) -> DataFrame:
    """Each gazetteer row with its country's row count and largest population, joined so that large countries are broadcast."""
    g = table(spark, d, "gn_excerpt").select("row_id", "country", "population")
    heavy = skew.bounded(spark, skew.heavy_keys(g.select("country"), "country", 0.01))
    dim = skew.aggregate_by_key(
        g, "country", [F.count(F.lit(1)).alias("n_rows"), F.max("population").alias("max_population")],
        [F.sum("n_rows").alias("n_rows"), F.max("max_population").alias("max_population")], heavy,
    )
    dim = dim.where(F.col("country").isNotNull())
    return skew.skew_join(g, dim, "country", heavy).select("row_id", "country", "population", "n_rows", "max_population")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return lines.rejected_lines(table(spark, d, "gn_lines"), ["line_id"]).select("line_id", "reason")


def p5_rejects(spark: SparkSession, d: str) -> DataFrame:
    """Rejected lines with the edits of their cheapest repair."""
    return lines.rejected_lines(table(spark, d, "gn_lines"), ["line_id", "file_name", "line_no"])


def p5_loaded(spark: SparkSession, d: str) -> DataFrame:
    return lines.load_lines(table(spark, d, "gn_lines"), ["line_id"])


def _schema(spark: SparkSession, d: str) -> list[tuple[str, int]]:
    """The wanted columns: a fixed table of 14 rows."""
    return [(r.tag_key, r.type) for r in table(spark, d, "tag_schema").orderBy("tag_key").collect()]


def p6_wide(spark: SparkSession, d: str) -> DataFrame:
    return wide.widen(table(spark, d, "tags"), _schema(spark, d))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    schema = _schema(spark, d)
    return wide.cells(wide.widen(table(spark, d, "tags"), schema), [(a, k) for a, k in schema if k in (wide.STRING, wide.INT)])


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return packed.split_inferred(table(spark, d, "gn_excerpt"), "alternatenames", "country", ["row_id"])


def p7_delimiters(spark: SparkSession, d: str) -> DataFrame:
    return packed.delimiter_scores(table(spark, d, "gn_excerpt"), "alternatenames", "country")


QUERIES = {
    f.__name__: f
    for f in (p2_found, p2_near, p2_in, p4_found, p4_keys, p4_country_rows, p5_found, p5_rejects, p5_loaded, p6_found, p6_wide, p7_found, p7_delimiters)
}

_POINTS = """pts AS (SELECT DISTINCT geonameid AS id, latitude AS lat, longitude AS lon FROM gn_excerpt
  WHERE latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180 AND NOT isnan(latitude) AND NOT isnan(longitude))"""
_NEAR = """SELECT DISTINCT a.id AS id_a, b.id AS id_b FROM pts a JOIN pts b ON a.id < b.id AND abs(a.lat - b.lat) < 0.0023
  AND 2 * 6371000.0 * asin(sqrt(least(1.0, pow(sin(radians(b.lat - a.lat) / 2), 2)
      + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))) <= 250"""
_EDGES = """poly AS (SELECT DISTINCT feature_id, geom.rings AS rings FROM features WHERE geom.typ = 3),
ring AS (SELECT feature_id, hash(rings) AS shape, unnest(rings) AS r FROM poly),
edge AS (SELECT feature_id, shape, r[i].x AS x1, r[i].y AS y1, r[i % len(r) + 1].x AS x2, r[i % len(r) + 1].y AS y2
  FROM (SELECT feature_id, shape, r, unnest(range(1, len(r) + 1)) AS i FROM ring WHERE len(r) > 0))"""
_IN = """SELECT DISTINCT id AS id_a, feature_id AS id_b FROM (
  SELECT p.id, p.lat, p.lon, e.feature_id, e.shape, count(*) AS n FROM pts p JOIN edge e
    ON least(e.y1, e.y2) <= p.lat AND greatest(e.y1, e.y2) >= p.lat AND (e.y1 > p.lat) <> (e.y2 > p.lat)
    AND p.lon < (e.x2 - e.x1) * (p.lat - e.y1) / (e.y2 - e.y1) + e.x1
  GROUP BY ALL HAVING count(*) % 2 = 1)"""
_TILE = """concat('4/', cast(greatest(0, least(floor((v.x + 180.0) / 360.0 * 16), 15)) AS INT), '/',
  cast(greatest(0, least(floor((1 - ln(tan(radians(greatest(-85.0511287, least(v.y, 85.0511287))))
    + 1 / cos(radians(greatest(-85.0511287, least(v.y, 85.0511287))))) / pi()) / 2 * 16), 15)) AS INT))"""
_KEYS = f"""WITH tiles AS (SELECT CASE WHEN v IS NULL OR v.x IS NULL OR v.y IS NULL THEN NULL ELSE {_TILE} END AS k
    FROM (SELECT geom.rings[1][1] AS v FROM features)),
keys AS (SELECT 'country' AS field, country AS "key", count(*) AS n, count(*) / (SELECT count(*) FROM gn_excerpt) AS share
    FROM gn_excerpt WHERE country IS NOT NULL GROUP BY country
  UNION ALL SELECT 'tile', k, count(*), count(*) / (SELECT count(*) FROM tiles) FROM tiles WHERE k IS NOT NULL GROUP BY k)"""
_FIELD = '(?:"(?:[^"]|"")*"|[^"\t]*)'
_NUM = "[+-]?[0-9]+(?:[.][0-9]+)?(?:[eE][+-]?[0-9]+)?"


def _at(i: int) -> str:
    """Text of the i-th field (from 0) of a line with valid quoting."""
    raw = f"regexp_extract(line, '^(?:{_FIELD}\t){{{i}}}({_FIELD})(?:\t|$)', 1)"
    return f"(CASE WHEN left({raw}, 1) = '\"' THEN replace(substr({raw}, 2, length({raw}) - 2), '\"\"', '\"') ELSE {raw} END)"


def _bad(i: int, limit: int) -> str:
    return f"(NOT regexp_full_match({_at(i)}, '{_NUM}') OR abs(try_cast({_at(i)} AS DOUBLE)) > {limit})"


_PARSED = f"""parsed AS (SELECT *, CASE
  WHEN line IS NULL THEN 'column_count'
  WHEN NOT regexp_full_match(line, '{_FIELD}(?:\t{_FIELD})*', 's') THEN 'quoting'
  WHEN length(line) - length(replace(line, '\t', '')) <> 18
    AND length(regexp_replace(line, '"(?:[^"]|"")*"', '', 'gs')) - length(replace(regexp_replace(line, '"(?:[^"]|"")*"', '', 'gs'), '\t', '')) <> 18 THEN 'column_count'
  WHEN length(regexp_replace(line, '"(?:[^"]|"")*"', '', 'gs')) - length(replace(regexp_replace(line, '"(?:[^"]|"")*"', '', 'gs'), '\t', '')) <> 18 THEN 'column_count'
  WHEN {_bad(4, 90)} THEN 'latitude' WHEN {_bad(5, 180)} THEN 'longitude' END AS reason FROM gn_lines)"""
_HEX = "concat(" + ", ".join(f"substr(hex(value), {15 - 2 * i}, 2)" for i in range(8)) + ")"
_U = f"CASE WHEN octet_length(value) = 8 THEN CAST(CAST('0x' || {_HEX} AS UBIGINT) AS HUGEINT) END"
_CELLS = f"""raw AS (SELECT feature_id, seq, lower(trim(key, ' ')) AS tag_key, value, type, {_U} AS u FROM tags WHERE value IS NOT NULL AND feature_id IS NOT NULL),
num AS (SELECT *, CASE WHEN u >= 9223372036854775808 THEN u - 18446744073709551616 ELSE u END AS i,
  CASE WHEN u >= 9223372036854775808 THEN -1.0 ELSE 1.0 END * CASE (u // 4503599627370496) % 2048 WHEN 0 THEN (u % 4503599627370496) / 4503599627370496.0::DOUBLE * pow(2.0, -1022)
     ELSE (1 + (u % 4503599627370496)::DOUBLE / 4503599627370496.0::DOUBLE) * pow(2.0, ((u // 4503599627370496) % 2048)::DOUBLE - 1023) END AS d FROM raw),
val AS (SELECT n.feature_id, n.seq, n.tag_key, s.type AS want,
  CASE s.type WHEN 0 THEN CASE n.type WHEN 0 THEN decode(value) WHEN 1 THEN CAST(i AS VARCHAR) END
    WHEN 1 THEN CASE n.type WHEN 1 THEN CAST(i AS VARCHAR) WHEN 2 THEN CASE WHEN floor(d) = d AND abs(d) < 9e18 THEN CAST(CAST(d AS BIGINT) AS VARCHAR) END
      WHEN 0 THEN CASE WHEN regexp_full_match(trim(decode(value), ' '), '[+-]?[0-9]+') THEN CAST(try_cast(trim(decode(value), ' ') AS BIGINT) AS VARCHAR) END END END AS v,
  CASE WHEN s.type = 2 THEN CASE n.type WHEN 2 THEN d WHEN 1 THEN CAST(i AS DOUBLE)
    WHEN 0 THEN CASE WHEN regexp_full_match(trim(decode(value), ' '), '{_NUM}') THEN try_cast(trim(decode(value), ' ') AS DOUBLE) END END END AS dv
  FROM num n JOIN tag_schema s USING (tag_key)),
best AS (SELECT feature_id, tag_key, want, max(v) FILTER (WHERE seq = top) AS v, max(dv) FILTER (WHERE seq = top) AS dv
  FROM (SELECT *, max(seq) OVER (PARTITION BY feature_id, tag_key) AS top FROM val WHERE v IS NOT NULL OR dv IS NOT NULL) GROUP BY ALL)"""
_NAMES = {"class": 0, "name": 0, "source": 0, "surface": 0, "ref": 0, "operator": 0, "maxspeed": 1, "lanes": 1, "layer": 1, "levels": 1, "population": 1, "height": 2, "width": 2, "incline": 2}
_WIDE = ", ".join(
    f"max({'dv' if k == 2 else 'TRY_CAST(v AS BIGINT)' if k == 1 else 'v'}) FILTER (WHERE tag_key = '{a}') AS \"{a}\"" for a, k in _NAMES.items()
)
_LOOKS = "regexp_full_match(trim(v, ' '), '[\\pL\\pM\\pN][^/:]*[\\pL\\pM\\pN)'']', 's')"
_PIECES = f"""count(*) AS segments, count(*) FILTER (n > 2) AS lists, CAST(sum(n) AS BIGINT) AS pieces, CAST(sum(ok) AS BIGINT) AS regular
  FROM (SELECT source, delimiter, len(p) AS n, len(list_filter(p, lambda v: {_LOOKS})) AS ok FROM (SELECT source, delimiter, string_split(s, delimiter) AS p FROM %s WHERE contains(s, delimiter)))"""
_SCORES = f"""WITH t AS (SELECT country AS source, translate(array_to_string(list_transform(string_split(alternatenames, '"'), lambda s, i: CASE WHEN i % 2 = 1 THEN s ELSE 'q' END), ''), '，；｜／：－＿', ',;|/:-_') AS t
  FROM gn_excerpt WHERE alternatenames <> ''),
c AS (SELECT unnest([{", ".join(f"'{c}'" for c in packed.CANDIDATES)}]) AS delimiter, unnest(range({len(packed.CANDIDATES)})) AS place),
whole AS (SELECT source, delimiter, t AS s FROM t, c),
raws AS (SELECT delimiter, lists / segments * regular / pieces AS raw FROM (SELECT delimiter, {_PIECES % "whole"} GROUP BY delimiter)),
better AS (SELECT c.delimiter, coalesce(string_agg(o.delimiter, ''), '') AS b FROM c LEFT JOIN raws f USING (delimiter) LEFT JOIN (SELECT c.delimiter, place, raw FROM c JOIN raws USING (delimiter)) o
  ON o.raw >= {packed.MIN_SCORE} AND (o.raw > coalesce(f.raw, 0) OR o.raw = coalesce(f.raw, 0) AND o.place < c.place) GROUP BY c.delimiter, c.place),
seg AS (SELECT source, delimiter, unnest(string_split(translate(t, b, repeat(chr(1), length(b))), chr(1))) AS s FROM t, better WHERE contains(t, delimiter)),
each AS (SELECT source, delimiter, {_PIECES % "seg"} GROUP BY source, delimiter),
total AS (SELECT delimiter, sum(lists) / sum(segments) AS l, sum(regular) / sum(pieces) AS r FROM each GROUP BY delimiter),
s AS (SELECT source, delimiter, segments, lists, pieces, regular, round((lists + {packed.PRIOR} * l) / (segments + {packed.PRIOR}) * ((regular + {packed.PRIOR} * r) / (pieces + {packed.PRIOR})), 6) AS score FROM each JOIN total USING (delimiter))"""

SQL = {
    "p2_near": f"WITH {_POINTS} {_NEAR}",
    "p2_in": f"WITH {_POINTS}, {_EDGES} {_IN}",
    "p2_found": f"WITH {_POINTS}, {_EDGES} SELECT 'near' AS kind, id_a, id_b FROM ({_NEAR}) UNION ALL SELECT 'in', id_a, id_b FROM ({_IN})",
    "p4_keys": f"{_KEYS} SELECT * FROM keys",
    "p4_found": f'{_KEYS} SELECT field, "key" AS hot_key FROM keys WHERE share >= 0.05',
    "p4_country_rows": """SELECT row_id, country, population,
  CASE WHEN country IS NULL THEN NULL ELSE count(*) OVER (PARTITION BY country) END AS n_rows,
  CASE WHEN country IS NULL THEN NULL ELSE max(population) OVER (PARTITION BY country) END AS max_population FROM gn_excerpt""",
    "p5_found": f"WITH {_PARSED} SELECT line_id, reason FROM parsed WHERE reason IS NOT NULL",
    "p5_loaded": f"WITH {_PARSED} SELECT line_id, "
    + ", ".join(f"{('nullif(%s, %s)' if k == 'string' else 'try_cast(nullif(%s, %s) AS ' + k + ')') % (_at(i), chr(39) * 2)} AS {n}" for i, (n, k) in enumerate(lines.GAZETTEER))
    + " FROM parsed WHERE reason IS NULL",
    "p6_found": f"WITH {_CELLS} SELECT feature_id, tag_key, v AS val FROM best WHERE want IN (0, 1)",
    "p6_wide": f"WITH {_CELLS} SELECT f.feature_id, {', '.join(chr(34) + a + chr(34) for a in _NAMES)} FROM (SELECT DISTINCT feature_id FROM tags WHERE feature_id IS NOT NULL) f LEFT JOIN (SELECT feature_id, {_WIDE} FROM best GROUP BY feature_id) w USING (feature_id)",
    "p7_found": """WITH parts AS (SELECT row_id, list_transform(regexp_extract_all(alternatenames, '(?:[^",;|，；｜]|"[^"]*(?:"|$))+'), lambda p: trim(p, ' ')) AS p
  FROM gn_excerpt WHERE alternatenames IS NOT NULL),
kept AS (SELECT row_id, list_filter(list_transform(p, lambda v: CASE WHEN length(v) >= 2 AND left(v, 1) = '"' AND right(v, 1) = '"'
    THEN trim(replace(substr(v, 2, length(v) - 2), '""', '"'), ' ') ELSE v END), lambda v: v <> '') AS p FROM parts)
SELECT row_id, CAST(i AS INT) AS pos, p[i + 1] AS item FROM (SELECT row_id, p, unnest(range(len(p))) AS i FROM kept)""",
    "p7_delimiters": f"{_SCORES} SELECT *, score >= {packed.MIN_SCORE} AS chosen FROM s",
}
