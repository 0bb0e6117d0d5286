"""Views over the driver's tables that give every operator an input of the right shape.

The SQL is written once and rendered for Spark and for DuckDB, so both engines see the same rows.
Every generated value is integer arithmetic carried through doubles in the same order.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("orders", "lineitem", "events", "embeddings", "customer", "supplier", "part")

# Black-key offsets within an octave, in white-key widths, and the black width.
_BLACK_FROM = {1: "0.6e0", 3: "1.75e0", 6: "3.6e0", 8: "4.63e0", 10: "5.66e0"}
_BLACK_WIDTH = "0.58e0"
_WHITE_OF = {0: 0, 2: 1, 4: 2, 5: 3, 7: 4, 9: 5, 11: 6}


def _case(expr: str, mapping: dict, default: str) -> str:
    arms = " ".join(f"WHEN {k} THEN {v}" for k, v in mapping.items())
    return f"CASE {expr} {arms} ELSE {default} END"


def _corner(c: int, values: tuple[str, str, str, str]) -> str:
    arms = {i: v for i, v in enumerate(values[:3])}
    return _case(f"(rot + {c}) % 4", arms, values[3])


def _px(axis: str, x: str, y: str) -> str:
    o, u, v = ("ox", "ux", "vx") if axis == "x" else ("oy", "uy", "vy")
    return f"(({o} + {u} * ({x}) + {v} * ({y})) / (1e0 + pg * ({x}) + pq * ({y})))"


def _faces() -> str:
    cols = []
    for c in range(4):
        tx = _corner(c, ("x_from", "x_to", "x_to", "x_from"))
        ty = _corner(c, ("0e0", "0e0", "depth", "depth"))
        cols.append(f"{_px('x', tx, ty)} AS t{c}x")
        cols.append(f"{_px('y', tx, ty)} - lift_px AS t{c}y")
    # front face: two corners on the top face, two on the keybed; a folded face shares all four
    for c, (fx, up) in enumerate((("x_to", "1"), ("x_from", "1"), ("x_from", "folded"), ("x_to", "folded"))):
        cols.append(f"CASE WHEN black = 1 THEN {_px('x', fx, 'depth')} END AS f{c}x")
        cols.append(f"CASE WHEN black = 1 THEN {_px('y', fx, 'depth')} - {up} * lift_px END AS f{c}y")
    return ",\n ".join(cols)


def _board_key_rows() -> str:
    """The standard boards' keys as literal rows, by the rule the DuckDB text states in SQL."""
    rows = []
    for white_keys, letter, first in ((29, "C", 60), (36, "C", 60), (45, "E", 64), (52, "A", 69)):
        base, last = 7 * (first // 12) - 12 + _WHITE_OF[first % 12], white_keys - 1
        for pitch in range(first, first + 2 * white_keys):
            octave, pc = 7 * (pitch // 12) - 12, pitch % 12
            black = pc in _BLACK_FROM
            order = octave + _WHITE_OF[pc - 1 if black else pc] - base
            if order > (last - 1 if black else last):
                break
            start = f"{octave}e0 + {_BLACK_FROM[pc]} - {base}" if black else f"{order}e0"
            width = _BLACK_WIDTH if black else "1e0"
            depth = "0.62e0" if black else "1e0"
            rows.append(
                f"({white_keys}, '{letter}', {first}, {pitch - first}, {int(black)}, {order}, "
                f"{start}, {start} + {width}, {depth})"
            )
    return ", ".join(rows)


_VIEWS: dict[str, str | dict[str, str]] = {
    "fx_frames": """
SELECT o_orderkey AS frame_id, o_custkey AS clip_id,
 row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS frame_index,
 640 AS width, 480 AS height,
 CASE o_orderkey % 4 WHEN 0 THEN 29 WHEN 1 THEN 36 WHEN 2 THEN 45 ELSE 52 END AS white_keys,
 CAST(8 + o_orderkey % 17 AS DOUBLE) AS key_px,
 CAST((o_orderkey * 7) % 91 AS DOUBLE) AS elevation_deg,
 CAST((o_orderkey * 13) % 100 AS DOUBLE) / 1e2 AS presence
FROM @orders""",
    "fx_points": """
SELECT l_orderkey AS frame_id, l_linenumber - 1 AS channel,
 row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
  l_extendedprice, l_quantity, l_shipdate) AS ord,
 l_partkey, l_suppkey, l_quantity,
 CAST(l_partkey % 640 AS DOUBLE) AS x,
 CAST((l_suppkey * 7 + CAST(l_quantity AS BIGINT)) % 480 AS DOUBLE) AS y
FROM @lineitem""",
    "fx_peaks": """
SELECT frame_id, channel, ord, x, y, l_quantity / 5e1 AS score FROM fx_points WHERE l_partkey % 10 <> 0""",
    "fx_labels": """
SELECT frame_id, channel, ord AS idx,
 x + CAST((l_partkey * 31) % 23 - 11 AS DOUBLE) AS x, y + CAST((l_suppkey * 17) % 9 - 4 AS DOUBLE) AS y
FROM fx_points WHERE l_suppkey % 12 <> 0""",
    "fx_notes": {
        "spark": """
SELECT user_id AS device_id, event_id AS ord, unix_micros(CAST(ts AS TIMESTAMP)) div 1000 AS ts_ms,
 60 + event_id % 3 AS pitch,
 CASE WHEN event_type IN ('purchase','error') THEN 128 WHEN event_type = 'signup' THEN 176 ELSE 144 END + event_id % 16 AS b0,
 CAST(floor(value) AS BIGINT) % 128 AS b2
FROM @events""",
        "duck": """
SELECT user_id AS device_id, event_id AS ord, epoch_us(ts) // 1000 AS ts_ms,
 60 + event_id % 3 AS pitch,
 CASE WHEN event_type IN ('purchase','error') THEN 128 WHEN event_type = 'signup' THEN 176 ELSE 144 END + event_id % 16 AS b0,
 CAST(floor(value) AS BIGINT) % 128 AS b2
FROM @events""",
    },
    "fx_heat_rows": """
SELECT vec_id, CAST(floor(vec_id / 16) AS BIGINT) AS frame_id, CAST(vec_id % 16 AS INT) AS i, embedding
FROM @embeddings""",
    "fx_cells": {
        "spark": """
SELECT frame_id, i, j, CAST(v AS DOUBLE) AS value
FROM fx_heat_rows LATERAL VIEW posexplode(embedding) e AS j, v""",
        "duck": """
SELECT frame_id, i, CAST(j AS INT) AS j, CAST(v AS DOUBLE) AS value
FROM (SELECT frame_id, i, unnest(range(64)) AS j, unnest(embedding) AS v FROM fx_heat_rows)""",
    },
    "fx_quads": """
SELECT o_orderkey AS frame_id,
 CAST(50 + o_orderkey % 100 AS DOUBLE) / 1e3 AS x0, CAST(200 + o_orderkey % 300 AS DOUBLE) / 1e3 AS y0,
 CAST(50 + o_orderkey % 100 + 150 + (o_orderkey * 3) % 700 AS DOUBLE) / 1e3 AS x1,
 CAST(200 + o_orderkey % 300 + (o_orderkey * 5) % 41 - 20 AS DOUBLE) / 1e3 AS y1,
 CAST(50 + o_orderkey % 100 + 150 + (o_orderkey * 3) % 700 + (o_orderkey * 11) % 61 - 30 AS DOUBLE) / 1e3 AS x2,
 CAST(200 + o_orderkey % 300 + (CASE WHEN o_orderkey % 19 = 0 THEN -1 ELSE 1 END) * ((o_orderkey * 17) % 230) AS DOUBLE) / 1e3 AS y2,
 CAST(50 + o_orderkey % 100 + (o_orderkey * 7) % 51 - 25 AS DOUBLE) / 1e3 AS x3,
 CAST(200 + o_orderkey % 300 + 5 + (o_orderkey * 13) % 190 AS DOUBLE) / 1e3 AS y3
FROM @orders""",
    "fx_boards": """
SELECT c_custkey AS frame_id,
 CASE c_custkey % 4 WHEN 0 THEN 29 WHEN 1 THEN 36 WHEN 2 THEN 45 ELSE 52 END AS white_keys,
 CASE c_custkey % 4 WHEN 0 THEN 'C' WHEN 1 THEN 'C' WHEN 2 THEN 'E' ELSE 'A' END AS phase,
 1280 AS width, 720 AS height,
 CAST(40 + c_custkey % 60 AS DOUBLE) AS ox, CAST(200 + c_custkey % 201 AS DOUBLE) AS oy,
 CAST(14 + c_custkey % 8 AS DOUBLE) AS ux, CAST(c_custkey % 5 - 2 AS DOUBLE) / 4e0 AS uy,
 CAST(c_custkey % 7 - 3 AS DOUBLE) AS vx, CAST(60 + c_custkey % 41 AS DOUBLE) AS vy,
 CAST(c_custkey % 3 - 1 AS DOUBLE) / 1e3 AS pg, CAST(c_custkey % 4 AS DOUBLE) / 1e2 AS pq,
 CAST(6 + c_custkey % 5 AS DOUBLE) AS lift_px, c_nationkey, c_acctbal
FROM @customer""",
    "fx_pitches": f"""
SELECT pitch, pc, CASE WHEN pc IN (1, 3, 6, 8, 10) THEN 1 ELSE 0 END AS black,
 octave * 7 - 12 + {_case('pc', _WHITE_OF, '-1')} AS white_index,
 octave * 7 - 12 + {_case('pc', {k + 1: v for k, v in _WHITE_OF.items() if k + 1 in _BLACK_FROM}, '-1')} AS white_below,
 CASE WHEN pc IN (1, 3, 6, 8, 10) THEN CAST(octave * 7 - 12 AS DOUBLE) + {_case('pc', _BLACK_FROM, '0e0')}
  ELSE CAST(octave * 7 - 12 + {_case('pc', _WHITE_OF, '-1')} AS DOUBLE) END AS unit_from,
 CASE WHEN pc IN (1, 3, 6, 8, 10) THEN {_BLACK_WIDTH} ELSE 1e0 END AS unit_width
FROM (SELECT n AS pitch, n % 12 AS pc, CAST(floor(n / 12) AS BIGINT) AS octave FROM @range192)""",
    "fx_board_keys": {
        "spark": f"SELECT * FROM VALUES {_board_key_rows()} AS "
        "t(white_keys, phase, first_pitch, semitone, black, white_ord, x_from, x_to, depth)",
        "duck": """
SELECT b.white_keys, b.phase, b.first_pitch, p.pitch - b.first_pitch AS semitone, p.black,
 CASE WHEN p.black = 1 THEN p.white_below - b.base ELSE p.white_index - b.base END AS white_ord,
 p.unit_from - b.base AS x_from, p.unit_from - b.base + p.unit_width AS x_to,
 CASE WHEN p.black = 1 THEN 0.62e0 ELSE 1e0 END AS depth
FROM (SELECT 29 AS white_keys, 'C' AS phase, 60 AS first_pitch, 23 AS base UNION ALL SELECT 36, 'C', 60, 23
 UNION ALL SELECT 45, 'E', 64, 25 UNION ALL SELECT 52, 'A', 69, 28) b
JOIN fx_pitches p ON (p.black = 0 AND p.white_index - b.base BETWEEN 0 AND b.white_keys - 1)
 OR (p.black = 1 AND p.white_below - b.base BETWEEN 0 AND b.white_keys - 2)""",
    },
    "fx_keys": f"""
SELECT frame_id, pitch, black, white_keys, width, height, {_faces()}
FROM (SELECT b.frame_id, b.white_keys, b.width, b.height, k.first_pitch + k.semitone AS pitch, k.black, k.x_from, k.x_to, k.depth,
  (b.frame_id + k.semitone) % 4 AS rot, b.ox, b.oy, b.ux, b.uy, b.vx, b.vy, b.pg, b.pq,
  CASE WHEN k.black = 1 THEN b.lift_px ELSE 0e0 END AS lift_px,
  CASE WHEN (b.frame_id + k.semitone) % 13 = 0 THEN 1 ELSE 0 END AS folded
 FROM fx_boards b JOIN fx_board_keys k ON b.white_keys = k.white_keys AND b.phase = k.phase
 WHERE NOT (b.frame_id % 11 = 0 AND k.black = 1) AND NOT (b.frame_id % 97 = 0 AND k.semitone > 0)) k""",
    "fx_template": {
        "spark": """
SELECT white_keys, phase, p.channel, p.ord, p.x, p.y FROM fx_board_keys LATERAL VIEW explode(CASE
 WHEN black = 1 THEN array(named_struct('channel', 5, 'ord', semitone - white_ord, 'x', x_from, 'y', 0.62e0),
  named_struct('channel', 6, 'ord', semitone - white_ord, 'x', x_to, 'y', 0.62e0))
 WHEN white_ord = 0 THEN array(named_struct('channel', 0, 'ord', 1, 'x', 0e0, 'y', 0e0),
  named_struct('channel', 1, 'ord', 1, 'x', CAST(white_keys AS DOUBLE), 'y', 0e0),
  named_struct('channel', 2, 'ord', 1, 'x', CAST(white_keys AS DOUBLE), 'y', 1e0),
  named_struct('channel', 3, 'ord', 1, 'x', 0e0, 'y', 1e0))
 ELSE array(named_struct('channel', 4, 'ord', white_ord, 'x', x_from, 'y', 1e0),
  named_struct('channel', 9, 'ord', white_ord, 'x', x_from, 'y', 0e0)) END) e AS p""",
        "duck": """
SELECT white_keys, phase, 0 AS channel, 1 AS ord, 0e0 AS x, 0e0 AS y FROM fx_board_keys WHERE semitone = 0
UNION ALL SELECT white_keys, phase, 1, 1, CAST(white_keys AS DOUBLE), 0e0 FROM fx_board_keys WHERE semitone = 0
UNION ALL SELECT white_keys, phase, 2, 1, CAST(white_keys AS DOUBLE), 1e0 FROM fx_board_keys WHERE semitone = 0
UNION ALL SELECT white_keys, phase, 3, 1, 0e0, 1e0 FROM fx_board_keys WHERE semitone = 0
UNION ALL SELECT white_keys, phase, 4, white_ord, x_from, 1e0 FROM fx_board_keys WHERE black = 0 AND white_ord >= 1
UNION ALL SELECT white_keys, phase, 9, white_ord, x_from, 0e0 FROM fx_board_keys WHERE black = 0 AND white_ord >= 1
UNION ALL SELECT white_keys, phase, 5, row_number() OVER (PARTITION BY white_keys, phase ORDER BY semitone), x_from, 0.62e0
 FROM fx_board_keys WHERE black = 1
UNION ALL SELECT white_keys, phase, 6, row_number() OVER (PARTITION BY white_keys, phase ORDER BY semitone), x_to, 0.62e0
 FROM fx_board_keys WHERE black = 1""",
    },
    "fx_drawn": f"""
SELECT frame_id, white_keys, phase, channel, ord, width, height,
 {_px('x', 'tx', 'ty')} + noise_x AS x_px, {_px('y', 'tx', 'ty')} - up * lift_px + noise_y AS y_px, score, h1, h2
FROM (SELECT b.*, t.channel, t.ord, t.x AS tx, t.y AS ty, t.up,
  CAST((b.frame_id * 7 + t.ord * 13 + t.channel * 5) % 21 - 10 AS DOUBLE) / 1e1 AS noise_x,
  CAST((b.frame_id * 5 + t.ord * 11 + t.channel * 3) % 21 - 10 AS DOUBLE) / 1e1 AS noise_y,
  5e-1 + CAST((b.frame_id + t.ord) % 50 AS DOUBLE) / 1e2 AS score,
  (b.frame_id * 31 + t.ord * 17 + t.channel * 7) % 9 AS h1,
  (b.frame_id * 13 + t.ord * 29 + t.channel * 3) % 23 AS h2
 FROM fx_boards b JOIN (
  SELECT white_keys, phase, channel, ord, x, y, 0 AS up FROM fx_template
  UNION ALL SELECT white_keys, phase, channel + 2, ord, x, y, 1 FROM fx_template WHERE channel IN (5, 6)
  UNION ALL SELECT white_keys, phase, channel + 5, ord, x, 0e0, 1 FROM fx_template WHERE channel IN (5, 6)) t
 ON b.white_keys = t.white_keys AND b.phase = t.phase) d""",
    "fx_fit_peaks": """
SELECT frame_id, white_keys, phase, width, height, channel, ord,
 (x_px + CASE WHEN h2 = 0 AND channel >= 4 THEN 5e0 ELSE 0e0 END) / width AS x,
 (y_px + CASE WHEN h2 = 0 AND channel >= 4 THEN 9e0 ELSE 0e0 END) / height AS y, score
FROM fx_drawn
WHERE NOT (channel >= 4 AND h1 = 0) AND NOT (channel IN (0, 1) AND frame_id % 5 = 0)
 AND NOT (channel IN (1, 2) AND frame_id % 29 = 0)""",
    "fx_truth": """
SELECT frame_id, white_keys, phase, width, height, ux / width AS h0, vx / width AS h1, ox / width AS h2,
 uy / height AS h3, vy / height AS h4, oy / height AS h5, pg AS h6, pq AS h7, 1e0 AS h8,
 0e0 AS lift0, -lift_px / height AS lift1, 0e0 AS lift2, 0.62e0 AS black_depth, c_nationkey
FROM fx_boards""",
}


def _render(name: str, dialect: str, sf_dir: str | None, boards: str = "@customer") -> str:
    body = _VIEWS[name]
    if isinstance(body, dict):
        body = body[dialect]
    if dialect == "spark":
        body = body.replace("@range192", "(SELECT id AS n FROM range(192))")
        body = body.replace("@customer", boards)
        return re.sub(r"@(\w+)", lambda m: f"parquet.`{sf_dir}/{m.group(1)}.parquet`", body)
    body = body.replace("@range192", "(SELECT range AS n FROM range(192))")
    return re.sub(r"@(\w+)", r"\1", body)


def _closure(names: tuple[str, ...], dialect: str) -> list[str]:
    ordered: list[str] = []

    def visit(name: str) -> None:
        body = _VIEWS[name]
        text = body if isinstance(body, str) else body[dialect]
        for other in _VIEWS:
            if other != name and re.search(rf"\b{other}\b", text):
                visit(other)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    return ordered


def duck_ctes(*names: str) -> str:
    """`WITH` items, without the keyword, that define the named views in DuckDB."""
    return ",\n".join(f"{n} AS ({_render(n, 'duck', None)})" for n in _closure(names, "duck"))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named fixture view over the tables under `sf_dir`.

    A board is a few bytes and grows to hundreds of rows, so boards are dealt by key over all shuffle partitions first: their
    file alone would make a task or two, and what is keyed by frame afterwards stays where it is.
    """
    dealt = f"(SELECT /*+ REPARTITION({int(spark.conf.get('spark.sql.shuffle.partitions'))}, c_custkey) */ c_custkey, c_nationkey, c_acctbal FROM @customer)"
    ctes = [f"{n} AS ({_render(n, 'spark', sf_dir, dealt)})" for n in _closure((name,), "spark")]
    return spark.sql(f"WITH {', '.join(ctes)} SELECT * FROM {name}")
