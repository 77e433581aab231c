"""Small inputs on which earlier versions failed at size."""

import random
from datetime import date

import oracle
import pytest
from pyspark.sql import functions as F

from cartorio.functions import approximate, nearest, pieces
from cartorio.functions.folding import fold
from cartorio.functions.label_keys import label_keys
from cartorio.gallery import ORACLES, QUERIES
from cartorio.operators import classify, labels, layout, privacy, reading
from cartorio.plans import extract
from cartorio.plans import types as spec
from cartorio.sources.rules import load_rules, profile_json


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_cells_over_bands_are_never_broadcast(spark):
    pages = spark.range(100).select(F.col("id").alias("doc_id"), F.lit(1).alias("page"))
    box = {"left": F.lit(0.0), "top": F.lit(0.0), "right": F.lit(320.0), "bottom": F.lit(640.0)}
    cells = pages.withColumns({"cell_no": F.explode(F.array(F.lit(0), F.lit(1))), **box})
    lines = pages.withColumns({"line_no": F.lit(1), "text": F.lit("a"), "confidence": F.lit(0.5), **box})
    blocks, loose = layout.assign_to_cells(cells, lines)
    assert "BroadcastHashJoin" not in _plan(blocks.select("doc_id", "text"))
    assert blocks.filter("cell_no = 0 AND text = 'a'").count() == 100 and loose.isEmpty()


def test_offsets_meet_their_lines_when_rows_change_their_order(spark):
    lines = spark.createDataFrame([(d, n, n * 10) for d in range(4) for n in range(50)], "doc_id long, line_no int, start int")
    places = spark.createDataFrame([(d, p) for d in range(4) for p in range(0, 500, 3)], "doc_id long, offset int")
    # Rows come in another order whenever the plan is run.
    mixed = places.mapInPandas(lambda parts: (p.sample(frac=1) for p in parts), places.schema)
    got = layout.attach_line(mixed, lines, chunk=64).collect()
    assert len(got) == 4 * 167 and all(r.line_no == r.offset // 10 for r in got)


def test_voters_numbers_do_not_survive_masking(spark, tmp_path):
    # Both have right check digits and stand in a longer text by chance.
    texts = [(1, "a 123456780191 b\n"), (2, "x102385010671y"), (3, None)]
    found = privacy.find_values(spark.createDataFrame([(d, 1, t) for d, t in texts], "doc_id long, line_no int, line string"))
    assert [r.kind for r in found.collect()] == [privacy.KIND_VOTER] * 2
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert QUERIES["pii_residual"](spark, str(tmp_path)).isEmpty()


def test_pieces_are_found_where_they_stand():
    rng = random.Random(3)
    texts = ["".join(rng.choice("AÇ𝒳b") for _ in range(rng.randint(0, 40))) for _ in range(200)] + [None, ""]
    wanted = ["".join(rng.choice("AÇ𝒳b") for _ in range(n)) for n in (1, 2, 3, 4, 5) for _ in range(4)]
    table = pieces.PieceTable(wanted)
    for text, found in zip(texts, table.find(texts, True).to_pylist()):
        want = {(p, i + 1) for p in wanted for i in range(len(text or "")) if text.startswith(p, i)}
        assert {(f["piece"], f["place"]) for f in found} == want and len(found) == len(want)
    for text, found in zip(texts, table.find(texts, False).to_pylist()):
        assert {f["piece"]: f["place"] for f in found} == {p: text.find(p) + 1 for p in wanted if text and p in text}
    assert pieces.PieceTable([]).find(["a", None], True).to_pylist() == [[], []]


def test_short_lists_make_no_rows_of_windows_and_agree_with_long_ones(spark, monkeypatch):
    rng = random.Random(5)
    items = [(n, "s", "".join(rng.choice("ABCD") for _ in range(rng.randint(1, 40)))) for n in range(60)]
    blocks = []
    for n in range(200):
        text = list("".join(rng.choice("ABCD") for _ in range(rng.randint(0, 5))) + rng.choice(items)[2])
        for _ in range(rng.randint(0, 3)):
            text[rng.randrange(len(text))] = rng.choice("ABCDE")
        blocks.append((n, rng.choice("st"), "".join(text)))
    left = spark.createDataFrame(items, "item_id int, sample string, item string")
    right = spark.createDataFrame([*blocks, (200, "s", None)], "block_no int, sample string, block string")

    def every():
        held = reading.expected_values(left, right).select("item_id", "exact", "block_no")
        pairs = reading.similar_pairs(left, right).select("item_id", "block_no", "edits")
        return sorted(map(tuple, held.collect()), key=repr), sorted(map(tuple, pairs.collect())), _plan(held)

    held, pairs, plan = every()
    assert "regexp_extract_all" not in plan
    monkeypatch.setattr(pieces, "PIECES_LIMIT", 0)
    assert every()[:2] == (held, pairs) and pairs and any(h[1] for h in held)


def test_grids_and_clusters_are_cut_from_pages_without_windows(spark):
    rng = random.Random(7)
    boxes = [(d, 1, f"t{n}", rng.choice([None, 0.5, 0.9]), float(rng.randint(0, 8) * 40), float(rng.randint(0, 4) * 20)) for d in range(40) for n in range(rng.randint(0, 20))]
    df = spark.createDataFrame(boxes, "doc_id int, page int, text string, confidence double, left double, top double").selectExpr("*", "left + 30 AS right", "top + 10 AS bottom")
    assert "Window" not in _plan(layout.assess_grids(df))
    clustered = layout.gap_clusters(df.withColumn("unit", F.lit(45.0)), "left", row="top")
    assert "Window" not in _plan(clustered)
    want = {}
    for doc in {b[0] for b in boxes}:
        cluster, before = 0, None
        for left, top in sorted((b[4], b[5]) for b in boxes if b[0] == doc):
            cluster += before is not None and left - before > 45
            before = left
            want.setdefault((doc, cluster), []).append(top)
    got = {}
    for row in clustered.collect():
        got.setdefault((row.doc_id, row.cluster), []).append(row.top)
        assert row.counted == (len(set(want[row.doc_id, row.cluster])) >= 3)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_misspelt_patterns_are_found_in_one_pass_and_as_by_joins(spark, monkeypatch):
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("ABCD") for _ in range(n))
    listed = [word(rng.randint(8, 45)) for _ in range(60)]
    texts = []
    for n in range(150):
        text = list(word(rng.randint(0, 6)) + rng.choice(listed) + word(rng.randint(0, 6)))
        for _ in range(rng.randint(0, 4)):
            text[rng.randrange(len(text))] = rng.choice(["", "A", "BC", "E"])
        texts.append((n, "".join(text)))
    left = spark.createDataFrame([*texts, (150, None), (151, "")], "doc_id int, compact string")
    right = spark.createDataFrame([(p,) for p in listed], "pattern_compact string")
    want = {(n, p, e) for n, t in texts for p in listed if (e := approximate.best_distance(p, t)) <= approximate.budget(p)}
    found = classify.fuzzy_join(left, right, "doc_id")
    assert "Join" not in _plan(found) and {tuple(r) for r in found.collect()} == want and len({e for _, _, e in want}) == 4
    monkeypatch.setattr(pieces, "PIECES_LIMIT", 0)
    joined = classify.fuzzy_join(left, right, "doc_id")
    assert "Join" in _plan(joined) and {tuple(r) for r in joined.collect()} == want


def test_closest_blocks_are_found_in_one_pass_and_agree_with_rounds(spark, monkeypatch):
    rng = random.Random(11)
    word = lambda most: "".join(rng.choice("ABÇ𝒳") for _ in range(rng.randint(0, most)))
    items = [(n, rng.choice("st"), word(200)) for n in range(30)] + [(30, "s", None), (31, None, "AB"), (32, "lone", "AB"), (33, "s", ""), (34, "s", "A" * 64), (35, "t", "B" * 128)]
    blocks = [(n if n % 9 else None, rng.choice("st"), word(260)) for n in range(150)] + [(1, "s", None), (2, None, "AB"), (3, "s", ""), (3, "t", "B" * 128), (2, "t", "B" * 128)]
    given = spark.createDataFrame(items, "item_id int, sample string, item string")
    offered = spark.createDataFrame(blocks * 2, "block_no int, sample string, block string")
    rounds = []
    by_rounds = reading._nearest_by_rounds
    monkeypatch.setattr(reading, "_nearest_by_rounds", lambda *args: rounds.append(1) or by_rounds(*args))
    # Several slices, and lanes of several lengths and numbers of words at once.
    monkeypatch.setattr(nearest, "SLICE", 4000)
    short = {tuple(r) for r in reading.closest_blocks(given, offered).collect()}
    assert not rounds and len(short) == 33
    monkeypatch.setattr(nearest, "TABLE_LIMIT", 0)
    assert {tuple(r) for r in reading.closest_blocks(given, offered).collect()} == short and rounds
    pairs = given.join(offered, "sample").filter("item IS NOT NULL AND block IS NOT NULL")
    plain = pairs.groupBy("item_id").agg(F.min(F.struct(F.levenshtein("item", "block").alias("distance"), "block_no", "block")).alias("b")).select("item_id", "b.*")
    assert {tuple(r) for r in plain.collect()} == short


def test_short_patterns_are_looked_for_in_one_pass_and_agree_with_runs_of_words(spark, monkeypatch):
    texts = ["the an of theandofthis", "THE", "then a the", "a b a b", "", None, "b-a  b", "the\nof ün", "x ab x", "ab"]
    docs = spark.createDataFrame(list(enumerate(texts * 2)), "doc_id int, text string")
    evidence = [("e", 0.5, ["the", "ün"]), ("f", 0.3, ["a b", "b a b"]), ("g", 0.2, ["ab", "heandoft"])]
    rules = load_rules(spark.createDataFrame([("T", 0, True, profile_json({k: (w, p) for k, w, p in evidence}, {}, 0.1))], "document_type string, position int, active boolean, rules_json string"))[0]
    want = [tuple(r) for r in classify.classify(docs, rules, fuzzy=False).select("doc_id", "document_type", "score", "signals").orderBy("doc_id").collect()]
    runs = []
    array_join = F.array_join
    monkeypatch.setattr(F, "array_join", lambda *args: runs.append(1) or array_join(*args))
    short = classify.classify_by_join(docs, rules)
    assert not runs and [tuple(r) for r in short.orderBy("doc_id").collect()] == want
    monkeypatch.setattr(pieces, "PIECES_LIMIT", 0)
    assert [tuple(r) for r in classify.classify_by_join(docs, rules).orderBy("doc_id").collect()] == want and runs


def test_lines_without_numbers_are_not_shuffled_by_masking(spark):
    lines = [(1, 1, "cpf 529.982.247-25 of 07/11/1984"), (1, 2, "plain " * 50), (2, 1, None), (2, 2, "12 34"), (3, 1, "07/11/1984"), (4, 1, "março/1999"), (5, 1, "52998224725")]
    given = spark.createDataFrame(lines, "doc_id long, line_no int, line string")
    masks = spark.createDataFrame([("CPF", "52998224725", "11144477735")], "kind string, value string, replacement string")
    found = privacy.find_values(given)
    for known in (None, found):
        masked = privacy.mask_lines(given, masks, keys=("doc_id", "line_no"), found=known)
        assert {(r.doc_id, r.line_no): r.masked for r in masked.collect()} == {
            (1, 1): "cpf 111.444.777-35 of 07/11/2034", (1, 2): "plain " * 50, (2, 1): None, (2, 2): "12 34", (3, 1): "07/11/2034", (4, 1): "março/2049", (5, 1): "11144477735",
        }
    assert "Union" in _plan(masked)


def test_neighbours_of_labels_are_worked_out_once_for_fields_and_reasons(spark, monkeypatch):
    times = []
    near = extract.page_neighbours
    monkeypatch.setattr(extract, "page_neighbours", lambda *args: times.append(1) or near(*args))
    lines = [(1, "BR_CNH", 1, n, t, t, None, None) for n, t in enumerate(["CPF", "529.982.247-25"])]
    schema = "doc_id long, document_type string, page int, line_no long, text string, folded string, confidence decimal(5,4), bbox array<double>"
    given = spark.createDataFrame(lines, schema).withColumns({c: F.lit(None).cast("double") for c in ("left", "top", "right", "bottom")})
    explained = extract.diagnose(given, date(2024, 6, 30))
    assert len(times) == 1
    assert explained.filter("path = 'cpf'").first()["normalized"] == "52998224725"


def test_pairs_of_a_page_are_worked_out_once_from_its_array(spark):
    plan = _plan(QUERIES["blocked_pairs"](spark, "/root/testdata/sf0.001"))
    assert "LeftAnti" not in plan and "Window" not in plan and "_band" not in plan
    rng = random.Random(9)
    boxes = [(1, 1, n, f"t{n}", float(rng.randint(0, 6) * 30), float(rng.randint(0, 9) * 15)) for n in range(40)] + [(1, 1, 40, "no box", None, None), (2, None, 0, "no page", 0.0, 0.0)]
    df = spark.createDataFrame(boxes, "doc_id int, page int, line_no int, text string, left double, top double").selectExpr("*", "left + 25 AS right", "top + 10 AS bottom")
    pairs = layout.neighbours(df, df)
    got = {(r.label_no, r.side, r["rank"]): r.line_no for r in pairs.collect()}
    places, want = {b[2]: (b[4], b[5]) for b in boxes[:40]}, {}
    for n, (x, y) in places.items():
        right = sorted((a, m) for m, (a, b) in places.items() if m != n and abs(b - y) <= 6 and a >= x + 22)
        below = sorted((b, a, m) for m, (a, b) in places.items() if m != n and y + 6.5 <= b <= y + 45 and abs(a - x) < 25)
        want |= {(n, "RIGHT", 1): m for _, m in right[:1]} | {(n, "BELOW", k + 1): m for k, (_, _, m) in enumerate(below[:2])}
    assert got == want
    marks = {n for n in places if n % 3 == 0}
    kept = {(r.label_no, r.side, r["rank"]) for r in layout.drop_blocked(pairs, df.filter("line_no % 3 = 0")).collect()}
    hidden = lambda n, v: any(m not in (n, v) and places[n][1] < places[m][1] < places[v][1] and abs(places[m][0] - places[n][0]) < 25 for m in marks)
    assert kept == {k for k, v in want.items() if not hidden(k[0], v)} != set(want)


def test_lines_are_compared_with_the_labels_they_may_meet_only(spark):
    rng = random.Random(11)
    types = {t.name: t.known_labels for t in spec.REGISTRY.values() if t.known_labels}
    texts = [(1, "BR_CNH", ""), (2, "UNKNOWN", "NOME: X"), (3, "BR_CNH", "2e1 NOME E SOBRENOME"), (4, None, "NOME"), (5, "BR_CIN", "CPF/NOME: MARIA")]
    for n in range(600):
        kind = rng.choice(list(types))
        letters = list(rng.choice(types[rng.choice(list(types))] if n % 5 == 0 else types[kind]))
        for _ in range(rng.randint(0, 4)):
            letters[rng.randrange(len(letters))] = rng.choice(["A", "", "BC", " ", "/"])
        texts.append((10 + n, kind, rng.choice(["", "3 ", "4a - "]) + "".join(letters) + rng.choice(["", ": ABC", " E MAIS"])))
    lines = spark.createDataFrame(texts, "id int, document_type string, text string").withColumn("folded", fold(F.col("text")))

    def sized(label: str):
        compact = labels.compact_label(label)
        return (label, compact, len(compact), min(3, len(compact) // 8), len(label) >= 12)

    known = spark.createDataFrame([(k, [sized(x) for x in v]) for k, v in types.items()], "document_type string, known array<struct<label:string,compact:string,size:int,budget:int,long:boolean>>")
    every = lines.join(known, "document_type").select("id", labels.matched_labels(F.col("text"), F.col("folded"), label_keys(F.col("folded")), F.col("known")).alias("labels"))
    marked = labels.match_labels(lines, types)
    got, want = ({r.id: r.labels for r in df.collect()} for df in (marked, every))
    assert got.pop(2) == got.pop(4) == [] and got == want
    assert sum(bool(v) for v in want.values()) > 100 and any(len(v) > 1 for v in want.values())
    # The labels of a type are a constant that is looked into, not a column that every line carries.
    assert "_known" not in marked._jdf.queryExecution().analyzed().toString()


def test_first_match_of_a_shape_is_found_without_the_others(spark):
    texts = ["", "sem", "x𝒳 CAPITAL SOCIAL de R$ 1.000,00 e CAPITAL SOCIAL R$ 2,00", "NIRE 12345678901 NIRE Nº: 10987654321", "SEDE NA RUA DAS FLORES, 1, CEP 01001-000."]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for shape in (extract.CAPITAL, extract.NIRE, extract.SEAT, extract.COMPANY):
        one, every = extract.first_located(F.col("t"), shape), extract.located(F.col("t"), shape)
        rows = df.select(one.alias("one"), F.get(every, F.lit(0)).alias("first")).collect()
        assert [r.one and tuple(r.one) for r in rows] == [r.first and (r.first["at"], r.first["value"]) for r in rows]


@pytest.mark.parametrize("name", ["pii_findings", "pii_summary", "allow_list", "pii_mask_map", "pii_masked_lines", "pii_residual"])
def test_numbers_follow_missing_empty_and_ended_texts_on_the_next_line(spark, tmp_path, name):
    ends = ["", "\n", "\r", "\r\n", "\n\n", "\n\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029", " ", "\t"]
    texts = [None, "", *ends, *(f"cpf 529.982.247-25\nlast{e}" for e in ends)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({c: F.lit("x") for c in ("source", "lang")}).write.parquet(f"{tmp_path}/parts")
    # DuckDB reads one file of that name.
    connection = oracle.duckdb.connect()
    connection.execute(f"COPY (SELECT * FROM '{tmp_path}/parts/*.parquet') TO '{tmp_path}/documents.parquet'")
    count, problem = oracle.compare(spark, oracle.connect(str(tmp_path)), name, QUERIES[name], ORACLES[name], str(tmp_path))
    assert problem is None and (count > 0) == (name != "pii_residual")
