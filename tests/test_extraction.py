"""Extraction cases beyond the regular pages: rejected, uncertain and missing values, and a type added at run time."""

from datetime import date

from pyspark.sql import functions as F

from cartorio.functions.folding import fold
from cartorio.plans import extract as ext
from cartorio.plans import types as spec

TODAY = date(2024, 6, 1)


def lines_of(spark, docs):
    """docs: id -> (type, [(text, left, top, width)])"""
    rows = [
        (i, kind, 1, n, text, 0.9, float(left), float(top), float(left + width), float(top + 20))
        for i, (kind, lines) in docs.items() for n, (text, left, top, width) in enumerate(lines)
    ]
    df = spark.createDataFrame(rows, "doc_id int, document_type string, page int, line_no bigint, text string, confidence double, left double, top double, right double, bottom double")
    return df.withColumns({"folded": fold(F.col("text")), "bbox": F.array("left", "top", "right", "bottom"), "confidence": F.col("confidence").cast("decimal(5,4)")})


def test_unusual_documents(spark):
    spec.register(spec.TypeSpec("CUSTOM", "custom-1", (spec.FieldSpec("total", "MONEY", ("TOTAL GERAL",)),)))
    try:
        docs = {
            1: ("BR_CNH", [("NOME", 50, 100, 60), ("MARIA", 50, 125, 80), ("APARECIDA SOUZA", 50, 150, 200), ("VALIDADE", 50, 200, 100), ("10/10/2020", 50, 225, 100), ("CPF", 300, 200, 50), ("111.444.777-36", 300, 225, 150), ("EMISSAO", 600, 200, 100), ("31/02/2019", 600, 225, 100)]),
            2: ("BR_CNH", [("algo 111.444.777-35 solto", 50, 100, 300)]),
            3: ("BR_PROOF_OF_ADDRESS", [("energia eletrica", 50, 40, 200), ("internet", 50, 80, 100), ("CPF/CNPJ: 111.444.777-36", 50, 140, 300)]),
            4: ("CUSTOM", [("TOTAL GERAL: R$ 1.000,50", 50, 40, 300)]),
            6: ("BR_CCMEI", [("ENDERECO COMERCIAL", 50, 40, 200), ("CAPITAL SOCIAL", 50, 70, 200), ("sem valor", 50, 95, 200)]),
            5: ("NO_EXTRACTOR", [("x", 0, 0, 10)]),
        }
        lines = lines_of(spark, docs)
        got = {(r["doc_id"], r["path"]): r for r in ext.diagnose(lines, TODAY).collect()}
    finally:
        del spec.REGISTRY["CUSTOM"]
    value = lambda doc, path: (got[(doc, path)]["status"], got[(doc, path)]["normalized"], got[(doc, path)]["messages"])
    assert value(1, "name") == ("VALID", "MARIA APARECIDA SOUZA", [])
    assert value(1, "expirationDate") == ("VALID", "2020-10-10", ["DATE_VALID", "DOCUMENT_EXPIRED"])
    assert value(1, "cpf") == ("INVALID", None, ["CHECK_DIGIT_INVALID"]) and float(got[(1, "cpf")]["confidence"]) == 0.6
    assert value(1, "issueDate") == ("INVALID", None, ["DATE_INVALID"]) and got[(1, "issueDate")]["raw"] == "31/02/2019"
    assert value(2, "cpf") == ("UNCERTAIN", "11144477735", ["CHECK_DIGIT_VALID", "NO_LABEL_NEARBY"])
    assert got[(2, "name")]["reason"] == "LABEL_NOT_FOUND" and got[(1, "cpf")]["reason"] == "VALIDATION_FAILED"
    assert got[(1, "registrationNumber")]["reason"] == "LABEL_NOT_FOUND"
    assert got[(2, "category")]["explanation"] == "None of the labels was found in the text: CAT. HAB., CAT. HAB, CAT HAB, CATEGORIA, CATEGORIA DE HABILITACAO."
    assert got[(1, "cpf")]["explanation"] == "A value was read but failed validation: CHECK_DIGIT_INVALID. The value as read is kept in raw."
    assert (got[(6, "address")]["reason"], got[(6, "address")]["label_lines"]) == ("VALUE_EMPTY", [0])
    assert got[(6, "shareCapital")]["explanation"] == "The label was found on line 1 and 1 candidate value(s) were examined, but none had the expected format."
    assert value(3, "serviceType") == ("UNCERTAIN", None, ["SERVICE_TYPE_AMBIGUOUS"])
    assert value(3, "holderDocument")[0] == "INVALID"
    assert value(4, "total") == ("VALID", "1000.50", ["FORMAT_VALID"])
    assert not any(doc == 5 for doc, _ in got)


def test_label_tables_match_as_constants_do(spark):
    import random

    from pyspark.sql import functions as F

    from cartorio.operators.labels import match_label_table, match_labels

    draw = random.Random(11)
    words = ["NOME", "DATA", "NASCIMENTO", "FILIACAO", "NATURALIDADE", "ORGAO", "EXPEDIDOR", "DE", "DO", "REGISTRO", "SOCIAL", "CIVIL", "No"]
    types = {n: list(dict.fromkeys(" ".join(draw.choices(words, k=draw.randint(1, 4))) for _ in range(60))) for n in ("A", "B")}

    def spoilt(label):
        for _ in range(draw.choice([0, 0, 1, 2, 3, 4])):
            at = draw.randrange(len(label) + 1)
            label = draw.choice([label[:at] + "X" + label[at:], label[:at] + label[at + 1 :], label[:at] + "Z" + label[at + 1 :]])
        return label

    rows = [(n % 7, draw.choice("ABC"), draw.choice(["", "12. ", "3A) "]) + spoilt(draw.choice(types["A"] + types["B"])) + draw.choice(["", ": 123", " MARIA", ":"])) for n in range(900)]
    rows += [(None, "A", ""), (1, None, "NOME"), (1, "A", "NOME " * 3000), (2, "A", types["A"][0]), (2, "A", types["A"][0])]
    lines = spark.createDataFrame(rows, "doc_id int, document_type string, text string").withColumn("folded", F.upper("text"))
    table = spark.createDataFrame([(n, label, i) for n, labels in types.items() for i, label in enumerate(labels)], "document_type string, label string, position int")
    found = lambda df: sorted(((r["doc_id"], r["document_type"], r["text"], [tuple(x) for x in r["labels"]], r["is_label"]) for r in df.collect()), key=repr)
    want = found(match_labels(lines.filter("document_type IS NOT NULL"), types))
    got = match_label_table(lines, table)
    assert found(got.filter("document_type IS NOT NULL")) == want and sum(r[4] for r in want) > 100
    assert [r["is_label"] for r in got.filter("document_type IS NULL").collect()] == [False]
    assert match_label_table(lines, table.limit(0)).filter("is_label").count() == 0
    many = table.unionByName(spark.range(10_000).select(F.lit("A").alias("document_type"), F.concat(F.lit("ROTULO NUMERO "), F.conv(F.col("id").cast("string"), 10, 36)).alias("label"), (F.col("id") + 100).cast("int").alias("position")))
    seen = match_label_table(lines, many)
    assert seen.filter("is_label").count() == sum(r[4] for r in want)
    far = spark.createDataFrame([(9, "A", "ROTULO NUMER0 5YC")], "doc_id int, document_type string, text string").withColumn("folded", F.upper("text"))
    assert "ROTULO NUMERO 5YC" in [x["label"] for r in match_label_table(far, many).collect() for x in r["labels"]]
