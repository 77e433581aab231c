"""Geometry and reading queries: line items laid out as boxes on pages, texts cut in lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from cartorio.functions.folding import compact_of, fold
from cartorio.gallery.base import query
from cartorio.session import cut_lineage
from cartorio.gallery.texts import LINES, fold_sql
from cartorio.operators import layout, reading
from cartorio.sources.lines import flatten_lines, to_lines

_BOX = (
    "doc_id, 1 AS page, line_no, CAST((line_no * 37 % 10) * 60 AS DOUBLE) AS \"left\", CAST((line_no * 53 % 12) * 25 AS DOUBLE) AS top, CAST((line_no * 37 % 10) * 60 + 40 + q AS DOUBLE) AS \"right\", "
    "CAST((line_no * 53 % 12) * 25 + 20 AS DOUBLE) AS bottom, concat('w', CAST(line_no AS {s})) AS text, CAST(q / 53 AS DECIMAL(5,4)) AS confidence"
)
BOXES = "boxes AS (SELECT " + _BOX.format(s="VARCHAR") + " FROM (SELECT l_orderkey AS doc_id, l_linenumber * 100000 + l_partkey AS line_no, min(l_quantity) AS q FROM lineitem GROUP BY 1, 2))"


def boxes(t):
    base = t.lineitem.groupBy(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") * 100000 + F.col("l_partkey")).alias("line_no")).agg(F.min("l_quantity").alias("q"))
    return base.selectExpr(*[c for c in _split(_BOX.format(s="STRING").replace('"', ""))])


def _split(text: str) -> list[str]:
    out, depth, current = [], 0, ""
    for char in text:
        depth += (char == "(") - (char == ")")
        if char == "," and depth == 0:
            out.append(current.strip())
            current = ""
        else:
            current += char
    return [*out, current.strip()]


_UP = "NOT ((v.bottom - v.top) > 1.5 * (v.\"right\" - v.\"left\") AND (v.bottom - v.top) > 2 * (l.bottom - l.top))"
NEIGHBOURS = (
    f"{BOXES}, r AS (SELECT l.doc_id, l.line_no AS label_no, v.line_no, 'RIGHT' AS side, row_number() OVER (PARTITION BY l.doc_id, l.line_no ORDER BY v.\"left\", v.line_no) AS rank FROM boxes l JOIN boxes v ON l.doc_id = v.doc_id AND l.line_no <> v.line_no "
    f"WHERE {_UP} AND abs((v.top + v.bottom) / 2 - (l.top + l.bottom) / 2) <= 0.6 * (l.bottom - l.top) AND v.\"left\" >= l.\"right\" - 0.3 * (l.bottom - l.top)), "
    "b AS (SELECT l.doc_id, l.line_no AS label_no, v.line_no, 'BELOW' AS side, row_number() OVER (PARTITION BY l.doc_id, l.line_no ORDER BY v.top, v.\"left\", v.line_no) AS rank FROM boxes l JOIN boxes v ON l.doc_id = v.doc_id AND l.line_no <> v.line_no "
    f"WHERE {_UP} AND v.top >= l.bottom - 0.35 * (l.bottom - l.top) AND v.top - l.bottom <= 3.5 * (l.bottom - l.top) AND (least(l.\"right\", v.\"right\") - greatest(l.\"left\", v.\"left\") > 0 OR abs(v.\"left\" - l.\"left\") <= 2 * (l.bottom - l.top))), "
    "pairs AS (SELECT * FROM r WHERE rank = 1 UNION ALL SELECT * FROM b WHERE rank <= 2)"
)


def _pairs(t):
    every = boxes(t)
    return layout.neighbours(every, every)


@query("spatial_neighbours", f"WITH {NEIGHBOURS} SELECT doc_id, label_no, line_no, side, CAST(CASE WHEN side = 'BELOW' THEN (rank - 1) * 0.05 ELSE 0 END AS DOUBLE) AS penalty FROM pairs")
def spatial_neighbours(t):
    return _pairs(t).select("doc_id", "label_no", "line_no", "side", "penalty")


@query(
    "blocked_pairs",
    f"WITH {NEIGHBOURS} SELECT p.doc_id, p.label_no, p.line_no, p.side FROM pairs p JOIN boxes l ON l.doc_id = p.doc_id AND l.line_no = p.label_no JOIN boxes v ON v.doc_id = p.doc_id AND v.line_no = p.line_no WHERE NOT EXISTS (SELECT 1 FROM boxes m WHERE m.doc_id = p.doc_id AND m.line_no % 3 = 0 AND m.line_no <> p.label_no AND m.line_no <> p.line_no "
    "AND (m.top + m.bottom) / 2 > (l.top + l.bottom) / 2 AND (m.top + m.bottom) / 2 < (v.top + v.bottom) / 2 AND (least(l.\"right\", m.\"right\") - greatest(l.\"left\", m.\"left\") > 0 OR abs(m.\"left\" - l.\"left\") <= 2 * (l.bottom - l.top)))",
)
def blocked_pairs(t):
    """Neighbours without a label printed between the two."""
    return layout.drop_blocked(_pairs(t), boxes(t).filter("line_no % 3 = 0")).select("doc_id", "label_no", "line_no", "side")


@query(
    "gap_clusters",
    f"WITH {BOXES}, c AS (SELECT *, CAST(coalesce(\"left\" - lag(\"left\") OVER w > 90, false) AS INTEGER) AS cut FROM boxes WINDOW w AS (PARTITION BY doc_id ORDER BY \"left\")), k AS (SELECT *, CAST(sum(cut) OVER (PARTITION BY doc_id ORDER BY \"left\") AS BIGINT) AS cluster FROM c) "
    "SELECT doc_id, cluster, count(*) AS boxes, count(DISTINCT top) >= 3 AS counted FROM k GROUP BY 1, 2",
)
def gap_clusters(t):
    clustered = layout.gap_clusters(boxes(t).withColumn("unit", F.lit(90.0)), "left", row="top")
    return clustered.groupBy("doc_id", "cluster").agg(F.count(F.lit(1)).alias("boxes"), F.bool_or("counted").alias("counted"))


_CELLS = "(SELECT o_orderkey AS doc_id, 1 AS page, c AS cell_no, CAST((c % 2) * 300 AS DOUBLE) AS \"left\", CAST((c // 2) * 140 AS DOUBLE) AS top, CAST((c % 2) * 300 + 320 AS DOUBLE) AS \"right\", CAST((c // 2) * 140 + 130 AS DOUBLE) AS bottom FROM orders, range(4) AS r(c))"
PLACED = (
    f"{BOXES}, cells AS {_CELLS}, owner AS (SELECT b.doc_id, b.line_no, min(c.cell_no) AS cell_no FROM boxes b JOIN cells c ON b.doc_id = c.doc_id AND (b.\"left\" + b.\"right\") / 2 BETWEEN c.\"left\" AND c.\"right\" AND (b.top + b.bottom) / 2 BETWEEN c.top AND c.bottom GROUP BY 1, 2)"
)


def cells(t):
    number = F.explode_outer(F.array(*[F.lit(n) for n in range(4)]))
    rows = t.orders.select(F.col("o_orderkey").alias("doc_id"), F.lit(1).alias("page"), number.alias("cell_no"))
    return rows.selectExpr(
        "doc_id", "page", "cell_no", "CAST((cell_no % 2) * 300 AS DOUBLE) AS left", "CAST(cell_no DIV 2 * 140 AS DOUBLE) AS top",
        "CAST((cell_no % 2) * 300 + 320 AS DOUBLE) AS right", "CAST(cell_no DIV 2 * 140 + 130 AS DOUBLE) AS bottom",
    )


@query(
    "cell_assignment",
    f"WITH {PLACED} SELECT o.doc_id, CAST(o.cell_no AS INTEGER) AS cell_no, string_agg(b.text, ' ' ORDER BY (b.top + b.bottom) / 2, (b.\"left\" + b.\"right\") / 2, b.line_no) AS text FROM owner o JOIN boxes b ON o.doc_id = b.doc_id AND o.line_no = b.line_no GROUP BY 1, 2",
)
def cell_assignment(t):
    blocks, _ = layout.assign_to_cells(cells(t), boxes(t))
    return blocks.select("doc_id", "cell_no", "text")


@query(
    "merged_text",
    f"WITH {PLACED} SELECT doc_id, CAST(sum(c) AS BIGINT) AS cells, CAST(sum(l) AS BIGINT) AS loose FROM (SELECT doc_id, count(DISTINCT cell_no) AS c, 0 AS l FROM owner GROUP BY 1 UNION ALL SELECT doc_id, 0, count(*) FROM boxes b WHERE NOT EXISTS (SELECT 1 FROM owner o WHERE o.doc_id = b.doc_id AND o.line_no = b.line_no) GROUP BY 1) GROUP BY doc_id",
)
def merged_text(t):
    """Cell blocks and loose lines in one reading order."""
    merged = layout.merge_text(*layout.assign_to_cells(cells(t), boxes(t)))
    return merged.groupBy("doc_id").agg(F.count_if(F.col("origin") == "CELL").alias("cells"), F.count_if(F.col("origin") == "LINE").alias("loose"))


@query("code_sets", "SELECT l_orderkey, CAST(count(DISTINCT l_suppkey) AS BIGINT) AS codes FROM lineitem GROUP BY 1")
def code_sets(t):
    return t.lineitem.select("l_orderkey", "l_suppkey").dropDuplicates().groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("codes"))


@query(
    "prose_lookup",
    f"WITH {LINES}, s AS (SELECT doc_id, line_no, CAST(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - length(line) - 1 AS BIGINT) AS start FROM lines), m AS (SELECT doc_id, (doc_id * 131 + k * 977) % n_chars AS pos FROM documents, range(5) AS r(k) WHERE n_chars > 0) "
    "SELECT m.doc_id, m.pos, max(s.line_no) AS line_no FROM m JOIN s ON m.doc_id = s.doc_id AND s.start <= m.pos GROUP BY 1, 2",
)
def prose_lookup(t):
    """The line an offset of the running text falls in."""
    lines = to_lines(t.documents)
    from cartorio.operators.ordering import ordered_positions  # noqa: F401
    from pyspark.sql import Window

    upto = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    starts = lines.select("doc_id", "line_no", F.coalesce(F.sum(F.length("line") + 1).over(upto), F.lit(0)).alias("start"))
    k = F.explode_outer(F.array(*[F.lit(n) for n in range(5)]))
    offsets = t.documents.filter("n_chars > 0").select("doc_id", "n_chars", k.alias("k")).selectExpr("doc_id", "(doc_id * 131 + k * 977) % n_chars AS offset").distinct()
    return layout.attach_line(offsets, starts).select("doc_id", F.col("offset").alias("pos"), "line_no")


@query(
    "flatten_lines",
    "WITH b AS (SELECT conv_id AS doc_id, turn, CAST(unnest(range(0, len(string_split(text, '. ')))) AS INTEGER) AS block_no, unnest(string_split(text, '. ')) AS text FROM conversations), k AS (SELECT * FROM b WHERE NOT regexp_matches(text, '^\\s*$')) "
    "SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY turn, block_no) - 1 AS line_no, sha256(trim(text, ' ' || chr(9) || chr(10) || chr(13))) AS digest FROM k",
)
def flatten(t):
    """Turns as pages, sentences as blocks, numbered through the conversation."""
    blocks = t.conversations.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_no"), F.posexplode_outer(F.split("text", "\\. ")).alias("block_no", "text"))
    return flatten_lines(blocks).select("doc_id", "line_no", F.sha2("text", 256).alias("digest"))


def visual_rows_sql(boxes: str, tolerance: float, name: str) -> str:
    """CTEs that number the rows of every page: one block a step, with the sum and count of the open row as its state."""
    return (
        f"{name}_unit AS (SELECT doc_id, page, coalesce(median(bottom - top) FILTER (bottom > top), 10.0) AS unit FROM {boxes} GROUP BY 1, 2), "
        f"{name}_order AS (SELECT *, (top + bottom) / 2 AS centre, row_number() OVER (PARTITION BY doc_id, page ORDER BY (top + bottom) / 2, \"left\", bottom - top, line_no) AS o FROM {boxes}), "
        f"{name}_fold AS (SELECT doc_id, page, o, 0 AS row, centre AS total, 1 AS n FROM {name}_order WHERE o = 1 UNION ALL "
        f"SELECT x.doc_id, x.page, x.o, CASE WHEN abs(x.centre - f.total / f.n) <= u.unit * {tolerance} THEN f.row ELSE f.row + 1 END, "
        f"CASE WHEN abs(x.centre - f.total / f.n) <= u.unit * {tolerance} THEN f.total + x.centre ELSE x.centre END, "
        f"CASE WHEN abs(x.centre - f.total / f.n) <= u.unit * {tolerance} THEN f.n + 1 ELSE 1 END "
        f"FROM {name}_fold f JOIN {name}_order x ON x.doc_id = f.doc_id AND x.page = f.page AND x.o = f.o + 1 JOIN {name}_unit u ON u.doc_id = x.doc_id AND u.page = x.page), "
        f"{name} AS (SELECT x.*, f.row, u.unit FROM {name}_order x JOIN {name}_fold f USING (doc_id, page, o) JOIN {name}_unit u USING (doc_id, page))"
    )


def segments_sql(boxes: str, scale: float) -> str:
    return (
        f"{visual_rows_sql(boxes, layout.SEGMENT_ROW_TOLERANCE, 'placed')}, "
        f"cuts AS (SELECT *, CASE WHEN \"left\" - lag(\"right\") OVER w > unit * {layout.SEGMENT_GAP} THEN 1 ELSE 0 END AS cut FROM placed WINDOW w AS (PARTITION BY doc_id, page, row ORDER BY \"left\", \"right\", text)), "
        "cut AS (SELECT *, sum(cut) OVER (PARTITION BY doc_id, page, row ORDER BY \"left\", \"right\", text) AS segment FROM cuts) "
        f"SELECT doc_id, string_agg(text, ' ' ORDER BY \"left\", \"right\", text) AS text, round(min(\"left\") * {scale}, 1) AS \"left\", round(min(top) * {scale}, 1) AS top, "
        f"round(max(\"right\") * {scale}, 1) AS \"right\", round(max(bottom) * {scale}, 1) AS bottom FROM cut GROUP BY doc_id, page, row, segment"
    )


def grids_sql(boxes: str) -> str:
    return (
        f"real_boxes AS (SELECT * FROM {boxes} WHERE trim(text) <> '' AND bottom > top), {visual_rows_sql('real_boxes', layout.GRID_ROW_TOLERANCE, 'placed')}, "
        "sized AS (SELECT *, count(*) OVER (PARTITION BY doc_id, page) AS boxes_, count(*) OVER (PARTITION BY doc_id, page, row) AS cells_ FROM placed), "
        f"wide AS (SELECT * FROM sized WHERE boxes_ >= {layout.MIN_ROWS * layout.MIN_CELLS} AND cells_ >= {layout.MIN_CELLS}), "
        "anchors AS (SELECT doc_id, page, row, unit, confidence, 0 AS anchor, \"left\" AS x FROM wide UNION ALL SELECT doc_id, page, row, unit, confidence, 1, \"right\" FROM wide "
        "UNION ALL SELECT doc_id, page, row, unit, confidence, 2, (\"left\" + \"right\") / 2 FROM wide), "
        "gaps AS (SELECT *, CASE WHEN x - lag(x) OVER (PARTITION BY doc_id, page, anchor ORDER BY x) > unit THEN 1 ELSE 0 END AS cut FROM anchors), "
        "clusters AS (SELECT *, sum(cut) OVER (PARTITION BY doc_id, page, anchor ORDER BY x) AS cluster FROM gaps), "
        f"used AS (SELECT doc_id, page, anchor, cluster FROM clusters GROUP BY ALL HAVING count(DISTINCT row) >= {layout.MIN_ROWS}), "
        "counted AS (SELECT * FROM clusters SEMI JOIN used USING (doc_id, page, anchor, cluster)), "
        f"full_rows AS (SELECT doc_id, page, anchor, row FROM counted GROUP BY ALL HAVING count(*) >= {layout.MIN_CELLS}), "
        "scored AS (SELECT doc_id, page, anchor, count(DISTINCT row) AS grid_rows, count(DISTINCT cluster) AS columns, (2 * CAST(sum(confidence * 10000) AS BIGINT) + count(*)) // (2 * count(*)) / 10000.0 AS mean "
        "FROM counted SEMI JOIN full_rows USING (doc_id, page, anchor, row) GROUP BY ALL), "
        f"best AS (SELECT *, grid_rows >= {layout.MIN_ROWS} AND columns >= {layout.MIN_COLUMNS} AS is_table FROM scored QUALIFY row_number() OVER (PARTITION BY doc_id, page ORDER BY grid_rows DESC, columns DESC, anchor) = 1), "
        f"every AS (SELECT DISTINCT doc_id, page FROM {boxes}) "
        "SELECT doc_id, coalesce(is_table, false) AS table_like, coalesce(grid_rows, 0) AS grid_rows, coalesce(columns, 0) AS columns, CASE WHEN is_table THEN mean END AS grid_confidence, "
        f"coalesce(is_table AND mean < {layout.GRID_CONFIDENCE}, false) AS triggers FROM every LEFT JOIN best USING (doc_id, page)"
    )


# Boxes whose centres drift from one to the next, so that only the mean of the open row decides; and orders as rows of a page.
_DRIFT = "boxes.* EXCLUDE (top, bottom), top + line_no * 29 % 17 AS top, bottom + line_no * 29 % 17 AS bottom"
DRIFTING = f"{BOXES}, drifting AS (SELECT {_DRIFT} FROM boxes)"
_GRID = (
    "CAST(l_orderkey AS BIGINT) AS order_no, CAST(floor(l_orderkey / 6) AS BIGINT) AS doc_id, 1 AS page, l_orderkey * 1000000000 + l_linenumber * 100000 + l_partkey AS line_no, "
    "CAST(l_linenumber * 80 + l_partkey % 12 AS DOUBLE) AS \"left\", CAST(l_orderkey % 6 * 30 + l_partkey % 7 AS DOUBLE) AS top, "
    "CAST(l_linenumber * 80 + l_partkey % 12 + 30 + l_partkey % 3 AS DOUBLE) AS \"right\", CAST(l_orderkey % 6 * 30 + l_partkey % 7 + 16 AS DOUBLE) AS bottom, "
    "concat('c', CAST(l_partkey AS {s})) AS text, CAST(0.70 + q / 250 AS DECIMAL(5,4)) AS confidence"
)
_CELLS = "(SELECT l_orderkey, l_linenumber, l_partkey, min(l_quantity) AS q FROM lineitem GROUP BY 1, 2, 3)"
GRID_BOXES = f"boxes AS (SELECT {_GRID.format(s='VARCHAR')} FROM {_CELLS})"


def drifting(t):
    shift = F.col("line_no") * 29 % 17
    return boxes(t).withColumns({"top": F.col("top") + shift, "bottom": F.col("bottom") + shift})


def grid_boxes(t):
    cells = t.lineitem.groupBy("l_orderkey", "l_linenumber", "l_partkey").agg(F.min("l_quantity").alias("q"))
    return cells.selectExpr(*_split(_GRID.format(s="STRING").replace('"', "")))


@query("line_rows", f"WITH RECURSIVE {BOXES}, {visual_rows_sql('boxes', 0.5, 'placed')} SELECT doc_id, count(DISTINCT row) AS rows, count(*) AS boxes FROM placed GROUP BY 1")
def line_rows(t):
    """Visual rows of the boxes of each page."""
    rows = layout.visual_rows(boxes(t), 0.5)
    return rows.groupBy("doc_id").agg(F.countDistinct("row").alias("rows"), F.count(F.lit(1)).alias("boxes"))


@query("drifting_rows", f"WITH RECURSIVE {DRIFTING}, {visual_rows_sql('drifting', 0.5, 'placed')} SELECT doc_id, line_no, row FROM placed")
def drifting_rows(t):
    """The row of every box, where boxes lie at slowly growing heights."""
    return layout.visual_rows(drifting(t), 0.5).select("doc_id", "line_no", "row")


@query("segments", f"WITH RECURSIVE {BOXES}, {segments_sql('boxes', 2.0)}")
def segments(t):
    return layout.assemble_segments(boxes(t).drop("confidence", "line_no"), scale=2.0).select("doc_id", "text", "left", "top", "right", "bottom")


@query("grid_assessment", f"WITH RECURSIVE {BOXES}, {grids_sql('boxes')}")
def grid_assessment(t):
    return layout.assess_grids(boxes(t)).select("doc_id", "table_like", "grid_rows", "columns", "grid_confidence", "triggers")


@query("grid_pages", f"WITH RECURSIVE {GRID_BOXES}, {grids_sql('boxes')}")
def grid_pages(t):
    """Pages whose rows are orders and whose cells are their items: most are tables, some with reason for a second reading."""
    return layout.assess_grids(grid_boxes(t).drop("order_no")).select("doc_id", "table_like", "grid_rows", "columns", "grid_confidence", "triggers")


def _letters_sql(text: str) -> str:
    return f"regexp_replace({fold_sql(text)}, '[^\\p{{L}}\\p{{Nd}}]+', '', 'g')"


# Every line of the benchmark texts is looked for among all lines of all documents.
_ITEMS = (
    f"item_lines AS (SELECT item_id AS text_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM benchmark), "
    f"items AS (SELECT text_id * 1000 + n AS item_id, 'all' AS sample, {_letters_sql('line')} AS item FROM item_lines WHERE {_letters_sql('line')} <> ''), "
    f"block_lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents), "
    f"blocks AS (SELECT 'all' AS sample, doc_id * 100000 + n AS block_no, {_letters_sql('line')} AS block FROM block_lines)"
)
_FOUND = (
    "f AS (SELECT *, EXISTS (SELECT 1 FROM blocks b WHERE contains(b.block, i.item)) OR EXISTS (SELECT 1 FROM blocks b WHERE abs(length(b.block) - length(i.item)) <= floor(round(greatest(length(b.block), length(i.item)) * 0.1, 9)) "
    "AND levenshtein(i.item, b.block) <= floor(round(greatest(length(b.block), length(i.item)) * 0.1, 9))) AS found FROM items i)"
)


def _items(t):
    def lines(table, number, scale):
        cut = table.select(number, F.posexplode(F.split("text", "\n")).alias("n", "line"))
        return cut.select((F.col(number) * scale + F.col("n") + 1).alias("no"), F.lit("all").alias("sample"), compact_of(fold(F.col("line"))).alias("line"))

    items = lines(t.benchmark, "item_id", 1000).select(F.col("no").alias("item_id"), "sample", F.col("line").alias("item")).filter("item <> ''")
    blocks = lines(t.documents, "doc_id", 100000).select(F.col("no").alias("block_no"), "sample", F.col("line").alias("block"))
    return cut_lineage(items), cut_lineage(blocks)


@query("read_recall", f"WITH {_ITEMS}, {_FOUND} SELECT item_id, found FROM f")
def read_recall(t):
    items, blocks = _items(t)
    return reading.read_recall(items, blocks).select("item_id", "found")


@query(
    "recall_by_chars",
    f"WITH {_ITEMS}, {_FOUND} SELECT round(count(*) FILTER (found) / CAST(count(*) AS DOUBLE), 4) AS item_recall, round(coalesce(sum(length(item)) FILTER (found), 0) / CAST(sum(length(item)) AS DOUBLE), 4) AS char_recall, count(*) FILTER (NOT found) AS missing FROM f",
)
def recall_by_chars(t):
    items, blocks = _items(t)
    return reading.recall_summary(reading.read_recall(items, blocks)).select("item_recall", "char_recall", "missing")


@query(
    "similar_lines",
    f"WITH {_ITEMS}, near AS MATERIALIZED (SELECT item_id, block_no, item, block, floor(round(greatest(length(block), length(item)) * 0.1, 9)) AS most FROM items JOIN blocks "
    "ON length(item) >= 3 AND length(block) BETWEEN length(item) * 0.89 AND length(item) * 1.12) "
    "SELECT item_id, block_no, CAST(levenshtein(item, block) AS INTEGER) AS edits FROM near WHERE abs(length(block) - length(item)) <= most AND levenshtein(item, block) <= most",
)
def similar_lines(t):
    """Lines of all documents that are like a line of a benchmark text, with their distance."""
    items, blocks = _items(t)
    return reading.similar_pairs(items, blocks).select("item_id", "block_no", "edits")


@query("expected_values_present", f"WITH {_ITEMS} SELECT item_id, min(block_no) IS NOT NULL AS exact, min(block_no) AS block_no FROM items i LEFT JOIN blocks b ON contains(b.block, i.item) GROUP BY item_id")
def expected_values_present(t):
    items, blocks = _items(t)
    return reading.expected_values(items, blocks).select("item_id", "exact", "block_no")


# DuckDB counts edits in bytes, so letters of several bytes are all written as one sign.
_OTHER = "[^\\x00-\\x7F]"


@query(
    "closest_lines",
    f"WITH {_ITEMS}, missing AS (SELECT item_id, regexp_replace(item, '{_OTHER}', '~', 'g') AS item FROM items i WHERE NOT EXISTS (SELECT 1 FROM blocks b WHERE contains(b.block, i.item))), "
    f"texts AS MATERIALIZED (SELECT regexp_replace(block, '{_OTHER}', '~', 'g') AS block, min(block_no) AS block_no FROM blocks GROUP BY 1), "
    "nearest AS (SELECT item_id, min({'d': levenshtein(item, block), 'n': block_no}) AS b FROM missing, texts GROUP BY 1) SELECT item_id, CAST(b.d AS INTEGER) AS distance, b.n AS block_no FROM nearest",
)
def closest_lines(t):
    """The line of all documents that is nearest to a line of a benchmark text that no line holds."""
    items, blocks = _items(t)
    missing = reading.expected_values(items, blocks).filter("NOT exact")
    signs = lambda name: F.regexp_replace(name, _OTHER, "~").alias(name)
    return reading.closest_blocks(missing.select("item_id", "sample", signs("item")), blocks.select("block_no", "sample", signs("block"))).select("item_id", "distance", "block_no")
