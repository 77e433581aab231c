"""Matching, classification, identifiers, privacy and reading on small inputs with known answers."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from cartorio.functions import approximate as ap
from cartorio.functions.check_digits import KINDS
from cartorio.functions.dates import parse_date, parse_long_date, parse_money, parse_month
from cartorio.functions.folding import fold
from cartorio.operators import classify as cls
from cartorio.operators import layout, privacy, reading
from cartorio.sources import rules as catalogue
from cartorio.sources.rules import load_rules, profile_json


def brute_distance(pattern: str, text: str) -> int:
    column = list(range(len(pattern) + 1))
    best = column[-1]
    for letter in text:
        last, column[0] = column[0], 0
        for i in range(1, len(pattern) + 1):
            last, column[i] = column[i], min(column[i] + 1, column[i - 1] + 1, last + (pattern[i - 1] != letter))
        best = min(best, column[-1])
    return best


def test_bit_parallel_distance_and_piece_filter_equal_brute_force():
    rng = random.Random(7)
    for _ in range(1500):
        pattern = "".join(rng.choice("ABC") for _ in range(rng.randint(8, 30)))
        text = "".join(rng.choice("ABC") for _ in range(rng.randint(0, 60)))
        if rng.random() < 0.7:
            noisy = list(pattern)
            for _ in range(rng.randint(0, 4)):
                noisy[rng.randrange(len(noisy))] = rng.choice("ABCX")
            cut = rng.randint(0, len(text))
            text = text[:cut] + "".join(noisy) + text[cut:]
        want = brute_distance(pattern, text)
        assert ap.best_distance(pattern, text) == want
        assert ap.PatternIndex([pattern]).search(text).get(0) == (want if want <= ap.budget(pattern) else None)


RULES = [
    ("A", 0, True, profile_json({"title": ("0.50", ["CADASTRO DE PESSOAS FISICAS"]), "cpf": ("0.10", ["CPF"]), "office": ("0.60", ["MINISTERIO DA FAZENDA"])}, {"other": ("0.60", ["CARTEIRA NACIONAL"])})),
    ("B", 1, True, profile_json({"title": ("0.50", ["CADASTRO DE PESSOAS FISICAS"]), "cpf": ("0.10", ["CPF"])})),
]


@pytest.mark.parametrize("fuzzy", [True, False])
def test_classification_cases(spark, fuzzy):
    rules = load_rules(spark.createDataFrame(RULES, "document_type string, position int, active boolean, rules_json string"))[0]
    texts = {
        1: "Cadastro de Pessoas Físicas\nCPF", 2: "CADASTRODEPESSOASFISICAS cpf", 3: "CADASTRO DE PESS0AS FISICAS CPF", 4: "CPF", 5: "", 6: "XCPFX cadastro de pessoas físicas",
        7: "ministério da fazenda cadastro de pessoas físicas cpf", 8: "ministerio da fazenda cadastro de pessoas fisicas carteira nacional",
    }
    got = {r["doc_id"]: (r["document_type"], r["score"]) for r in cls.classify(spark.createDataFrame(list(texts.items()), "doc_id int, text string"), rules, fuzzy=fuzzy).collect()}
    near = ("A", Decimal("0.6000"))
    assert got[1] == near and got[2] == near and got[7] == ("A", Decimal("1.0000"))
    assert got[3] == (near if fuzzy else ("UNKNOWN", None))
    assert got[4] == got[5] == got[6] == ("UNKNOWN", None)
    assert got[8] == ("UNKNOWN", None)
    lowered = {r["doc_id"]: r["document_type"] for r in cls.classify(spark.createDataFrame(list(texts.items()), "doc_id int, text string"), rules, Decimal("0.10"), fuzzy=fuzzy).collect()}
    assert lowered[4] == "A" and lowered[5] == "UNKNOWN" and lowered[8] in ("A", "B")


@pytest.mark.parametrize("fuzzy", [True, False])
def test_both_sides_of_the_catalogue_limit(spark, monkeypatch, fuzzy):
    zero = profile_json({"seal": ("0.20", ["SELO"]), "office": ("0.30", ["MINISTERIO DA FAZENDA NACIONAL", "FAZENDA"])}, {"other": ("0.60", ["CARTEIRA NACIONAL"])}, threshold="0")
    texts = [
        "Cadastro de Pessoas Físicas\nCPF", "CADASTRODEPESSOASFISICAS cpf", "CADASTRO DE PESS0AS FISICAS CPF", "CPF", "", None, " ", "selo", "selo carteira nacional", "selo carte1ra nacional",
        "ministério da fazenda cadastro de pessoas físicas cpf", "min1ster1o da fazenda naciona1", "CPF", "nothing of it",
    ]
    docs = spark.createDataFrame([(i if i % 6 else None, t) for i, t in enumerate(texts)] + [(1, texts[0]), (2, "selo")], "doc_id int, text string")
    few, more = (
        load_rules(spark.createDataFrame(types, "document_type string, position int, active boolean, rules_json string"))[0]
        for types in (RULES, RULES + [("Z", 5, True, zero), ("Y", 5, True, zero)])
    )
    made = {
        "few": lambda: cls.expected_divergence(cls.classify(docs.withColumn("expected_type", F.lit("A")), few, fuzzy=fuzzy)),
        "more": lambda: cls.classify(docs, more, fuzzy=fuzzy),
        "minimum": lambda: cls.classify(docs, more, Decimal("0.10"), fuzzy=fuzzy),
        "explain": lambda: cls.explain_classification(docs, more, fuzzy=fuzzy),
        "flags": lambda: cls.evidence_flags(docs, more, fuzzy=fuzzy),
    }
    for name, make in made.items():
        within = make()
        with monkeypatch.context() as m:
            m.setattr(catalogue, "CATALOGUE_LIMIT_ROWS", 3)
            beyond = make()
        assert within.dtypes == beyond.dtypes, name
        want, got = (sorted(map(repr, df.collect())) for df in (within, beyond))
        assert want == got and want, name


def test_explanation_names_kind_edits_and_reason(spark):
    rules = load_rules(spark.createDataFrame(RULES, "document_type string, position int, active boolean, rules_json string"))[0]
    docs = spark.createDataFrame([(1, "CADASTRO DE PESS0AS FISICAS CPF"), (2, "cpf"), (3, " ")], "doc_id int, text string")
    explained = cls.explain_classification(docs, rules)
    row = explained.filter("doc_id = 1 AND document_type = 'A'").first()
    title = row["evidence"][0]
    assert (title["kind"], title["edits"], row["accepted"], row["chosen"]) == ("FUZZY", 1, True, True)
    assert row["reason"] == "Score 0.60 reached the threshold 0.60. Found: title, cpf."
    other = explained.filter("doc_id = 1 AND document_type = 'B'").first()
    assert other["reason"].endswith("Not chosen: A scored higher (0.60).")
    reasons = {r["doc_id"]: r["reason"] for r in cls.decisions(explained).collect()}
    assert reasons[2] == "No type reached its threshold. Closest: A with score 0.10 of 0.60."
    assert reasons[3] == "The text is empty, so there was nothing to classify."


def test_identifiers(spark):
    cases = [
        ("CPF", "529.982.247-25", True), ("CPF", "52998224726", False), ("CPF", "11111111111", False), ("CPF", "5299822472", None), ("CPF", "529.982.247-2x", None),
        ("CNPJ", "11.222.333/0001-81", True), ("CNPJ", "12ABC34501DE35", True), ("CNPJ", "12abc34501de35", True), ("CNPJ", "12ABC34501DE36", False), ("CNPJ", "00000000000000", False),
        ("CEP", "01001-000", True), ("CEP", "00000-000", None), ("UF", "são paulo", True), ("UF", "XX", None), ("RG", "MG-12.345.678", True), ("RG", "123", None),
    ]
    rows = spark.createDataFrame(cases, "kind string, value string, expected boolean")
    for kind, (normalize, valid) in KINDS.items():
        for r in rows.filter(F.col("kind") == kind).withColumn("n", normalize(F.col("value"))).withColumn("v", valid(F.col("n")) if valid else F.lit(True)).collect():
            assert (r["v"] if r["n"] is not None else None) == r["expected"], (kind, r["value"])


def test_dates_and_money(spark):
    row = spark.range(1).select(
        parse_date(F.lit("31/02/2020")).alias("a"), parse_date(F.lit("1-2.2020")).alias("b"), parse_date(F.lit("01/01/0000")).alias("c"), parse_date(F.lit("1/1/20")).alias("d"),
        parse_long_date(F.lit("5 de março de 2020")).alias("e"), parse_long_date(F.lit("31 de abril de 2020")).alias("f"), parse_month(F.lit("5/2023")).alias("g"), parse_month(F.lit("13/2023")).alias("h"),
        *[parse_money(F.lit(v)).alias(f"m{i}") for i, v in enumerate(["R$ 1.234,56", "1234", "12.34,00", "1.234.567,8", "r$0,05", ",50"])],
    ).first()
    assert row["a"] is None and str(row["b"]) == "2020-02-01" and row["c"] is None and row["d"] is None
    assert str(row["e"]) == "2020-03-05" and row["f"] is None and row["g"] == "2023-05" and row["h"] is None
    assert [row[f"m{i}"] for i in range(6)] == ["1234.56", "1234.00", None, None, "0.05", None]


def test_masking_text(spark):
    df = spark.createDataFrame(
        [("p", 1, "nasc. 07/11/1985 ref Março/2021 e 99/99/12345"), ("p", 2, "Rua das Palmeiras, 10"), ("p", 3, "São Paulo - SP - CEP: 01310-100"), ("p", 4, "R$475,44 José da Silvá LTDA")],
        "path string, line_no int, line string",
    )
    phrases = privacy.phrase_table(["jose da silva => FULANO", "LTDA"])
    masked = df.withColumn("masked", privacy.mask_phrases(privacy.mask_dates(F.col("line")), phrases))
    got = {r["line_no"]: r["masked"] for r in privacy.mask_addresses(masked, "path").collect()}
    assert got[1] == "nasc. 07/11/2035 ref Março/2031 e 99/99/12345"
    assert got[2] == "R EXEMPLO DA SILVA, 1" and got[3] == "CIDADE EXEMPLO 2 - SP - CEP 01310-100"
    assert got[4] == "R$475,44 FULANO EMPRESA EXEMPLO 1 LTDA"


def test_masks_are_not_masked_again_and_longer_numbers_stay(spark):
    a, b, c = "111.444.777-35", "529.982.247-25", "390.533.447-05"
    lines = spark.createDataFrame(
        [("p", 1, f"{a} e {b}, {a}"), ("p", 2, "CPF 11144477735 em 9911144477735000"), ("p", 3, "nada 123"), ("p", 4, f"{b}")], "path string, line_no long, line string"
    )
    masks = spark.createDataFrame([("CPF", x.replace(".", "").replace("-", ""), y.replace(".", "").replace("-", "")) for x, y in ((a, b), (b, c))], "kind string, value string, replacement string")
    got = {r.line_no: r.masked for r in privacy.mask_lines(lines, masks).collect()}
    assert got == {1: f"{b} e {c}, {b}", 2: "CPF 52998224725 em 9911144477735000", 3: "nada 123", 4: c}


def test_names_by_constants_and_by_join_agree(spark, monkeypatch):
    lines = spark.createDataFrame([("a", 1, "fala com José da Silva hoje"), ("a", 2, "ab"), ("b", 1, "nada")], "path string, line_no int, line string")
    names = spark.createDataFrame([("JOSE DA SILVA",), ("Zé",), ("ab",), ("# x",), ("  ",)], "name string")
    constants = sorted(tuple(r) for r in privacy.scan_names(lines, names).collect())
    monkeypatch.setattr(privacy, "NAME_CONSTANTS", 0)
    assert sorted(tuple(r) for r in privacy.scan_names(lines, names).collect()) == constants == [("a", 1, "nome real", "contem 'JO...'"), ("a", 2, "nome real", "contem 'ab...'")]


def test_grid_rows_and_segments(spark):
    cells = [(1, 1, f"c{r}{c}", 0.7, 100.0 * c, 40.0 * r, 100.0 * c + 50, 40.0 * r + 20) for r in range(4) for c in range(3)]
    prose = [(2, 1, f"p{r}", 0.9, 10.0, 40.0 * r, 400.0, 40.0 * r + 20) for r in range(12)]
    blocks = spark.createDataFrame(cells + prose, "doc_id int, page int, text string, confidence double, left double, top double, right double, bottom double")
    got = {r["doc_id"]: r for r in layout.assess_grids(blocks).collect()}
    assert (got[1]["table_like"], got[1]["grid_rows"], got[1]["columns"], got[1]["grid_confidence"], got[1]["triggers"]) == (True, 4, 3, 0.7, True)
    assert not got[2]["table_like"] and not got[2]["triggers"]
    words = spark.createDataFrame(
        [(1, 1, "Nome", 10.0, 10.0, 40.0, 20.0), (1, 1, "completo", 43.0, 11.0, 90.0, 21.0), (1, 1, "Valor", 200.0, 10.5, 240.0, 20.5), (1, 1, "baixo", 10.0, 40.0, 40.0, 50.0)],
        "doc_id int, page int, text string, left double, top double, right double, bottom double",
    )
    assert sorted(r["text"] for r in layout.assemble_segments(words).collect()) == ["Nome completo", "Valor", "baixo"]


def test_reading_by_similarity_and_closest(spark):
    items = spark.createDataFrame([(1, "s", "CADASTRO DE PESSOAS"), (2, "s", "TOTAL"), (3, "s", "INEXISTENTE AQUI")], "item_id int, sample string, item string")
    blocks = spark.createDataFrame([("s", 1, "CADASTR0 DE PESSOAS"), ("s", 2, "X TOTAL GERAL")], "sample string, block_no int, block string")
    marked = {r["item_id"]: r["found"] for r in reading.read_recall(items, blocks).collect()}
    assert marked == {1: True, 2: True, 3: False}
    assert [r["closest"] for r in reading.closest_blocks(items.filter("item_id = 1"), blocks).collect()] == ["CADASTR0 DE PESSOAS"]


def test_folding_keeps_sharp_s_and_drops_marks(spark):
    row = spark.createDataFrame([("straße É́ ª  x",)], "t string").select(fold(F.col("t")).alias("f")).first()
    assert row["f"] == "STRAßE E ª X"


def test_similar_pairs_against_all_pairs(spark):
    import random

    from cartorio.operators import reading

    rnd = random.Random(17)
    base = ["".join(rnd.choice("abcd") for _ in range(rnd.choice([3, 9, 10, 19, 20, 35, 60]))) for _ in range(25)]

    def spoiled(text):
        for _ in range(rnd.randint(0, max(1, len(text) // 8))):
            at = rnd.randrange(len(text))
            text = text[:at] + rnd.choice(["", "x", "ab", text[at]]) + text[at + rnd.randint(0, 1) :]
        return text

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = following(row, i, x, b)
        return row[-1]

    def following(row, i, x, b):
        out = [i]
        for j, y in enumerate(b, 1):
            out.append(min(row[j] + 1, out[-1] + 1, row[j - 1] + (x != y)))
        return out

    items = [(i, rnd.choice("st"), t) for i, t in enumerate(base)] + [(90, "s", None), (91, "s", "ab")]
    blocks = [(n, rnd.choice("st"), spoiled(rnd.choice(base))) for n in range(150)] + [(900, "s", None), (901, "s", "ab"), (902, "t", "")]
    got = reading.similar_pairs(spark.createDataFrame(items, "item_id int, sample string, item string"), spark.createDataFrame(blocks, "block_no int, sample string, block string")).collect()
    want = {
        (i, n, distance(a, b)) for i, s, a in items for n, t, b in blocks
        if s == t and a and b and min(len(a), len(b)) >= 3 and distance(a, b) <= int(max(len(a), len(b)) * 0.1 + 1e-9)
    }
    assert {(r.item_id, r.block_no, r.edits) for r in got} == want and len(want) > 30 and len(got) == len(want)


def test_closest_blocks_are_those_of_all_pairs(spark):
    import random

    draw = random.Random(5)
    word = lambda n: "".join(draw.choice("ABCDEÉ") for _ in range(n))
    blocks = [(draw.choice("st"), n, word(draw.choice([0, 1, 3, 8, 20, 60]))) for n in range(80)] + [("s", 90, None), ("u", 91, "AB"), ("s", 92, "A" * 700)]
    blocks += [(s, n + 100, b) for s, n, b in blocks[:10]]
    items = [(n, draw.choice(["s", "t", "s", "t", "none", None]), word(draw.choice([0, 2, 9, 25, 70]))) for n in range(40)] + [(50, "s", None), (51, "u", "XYZ"), (52, "s", "B" * 650)]

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    want = {}
    for n, sample, item in items:
        near = [(distance(item, b), no, b) for s, no, b in blocks if s == sample and b is not None] if item is not None else []
        if near:
            want[n] = min(near)
    got = reading.closest_blocks(spark.createDataFrame(items, "item_id int, sample string, item string"), spark.createDataFrame(blocks, "sample string, block_no int, block string"))
    assert {r["item_id"]: (r["distance"], r["block_no"], r["closest"]) for r in got.collect()} == want and len(want) > 25
    empty = spark.createDataFrame([], "item_id int, sample string, item string")
    assert reading.closest_blocks(empty, spark.createDataFrame(blocks, "sample string, block_no int, block string")).count() == 0
