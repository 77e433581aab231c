"""Captured pages laid out from customer keys, one document type per remainder of seven, and their extraction.

Every printed value is a function of the key, so the right answer of each field is plain SQL.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from cartorio.functions.folding import fold
from cartorio.functions.machine_zone import fully_valid
from cartorio.gallery.base import query
from cartorio.gallery.texts import _dotted_cnpj, _dotted_cpf, _sum, add_numbers, numbers_sql
from cartorio.operators import labels as lab
from cartorio.operators import layout
from cartorio.plans import extract as ext
from cartorio.plans import types as spec
from cartorio.session import cut_lineage, spread

TODAY = date(2024, 6, 30)
TYPES = ("BR_CPF_CARD", "BR_CNH", "BR_CIN", "BR_PROOF_OF_ADDRESS", "BR_CNPJ_CARD", "BR_CCMEI", "BR_SOCIAL_CONTRACT")


def _person(spark: bool) -> dict[str, list[dict[str, str]]]:
    """Columns of a made-up person, in stages; later stages use earlier ones."""
    s = "STRING" if spark else "VARCHAR"
    pick = (lambda items, n: f"element_at(array({items}), CAST({n} AS INT) + 1)") if spark else (lambda items, n: f"([{items}])[CAST({n} AS INT) + 1]")
    day = (lambda start, n: f"date_add(DATE '{start}', CAST({n} AS INT))") if spark else (lambda start, n: f"(DATE '{start}' + CAST({n} AS INT))")
    show = (lambda d, f: f"date_format({d}, '{ {'d': 'dd/MM/yyyy', 'y': 'yyMMdd', 'i': 'yyyy-MM-dd', 'm': 'MM/yyyy', 'n': 'yyyy-MM'}[f] }')") if spark else (
        lambda d, f: f"strftime({d}, '{ {'d': '%d/%m/%Y', 'y': '%y%m%d', 'i': '%Y-%m-%d', 'm': '%m/%Y', 'n': '%Y-%m'}[f] }')")
    mrz = (7, 3, 1)
    digit = lambda text, n: f"CAST({_sum(text, [mrz[i % 3] for i in range(n)])} % 10 AS {s})"
    composite = [mrz[i % 3] for i in range(10)] + [mrz[(25 + i) % 3] for i in range(14)]
    bad = f"concat(substr(cpf, 1, 10), CAST((CAST(substr(cpf, 11, 1) AS INT) + 1) % 10 AS {s}))"
    d, a = _sum("substr(cpf, 1, 9)", range(9, 0, -1)), _sum("substr(cpf, 1, 9)", range(1, 10))
    return [
        {
            "given": pick("'MARIA', 'JOAO', 'ANA', 'PEDRO', 'LUCIA'", "c_custkey % 5"),
            "family": pick("'SILVA', 'SOUZA', 'COSTA'", "c_custkey % 3"),
            "born": day("1950-01-01", "c_custkey * 37 % 15000"), "issued": day("2015-01-01", "c_custkey % 2000"),
            "ends": day("2022-01-01", "c_custkey * 13 % 3000"), "cpf_bad": bad,
            "desc_rest": f"{d} % 11", "asc_rest": f"{a} % 11",
        },
        {
            "person": "concat(given, ' DA ', family)", "mother": "concat('TEREZA DE ', family)", "company": "concat('COMERCIAL ', family, ' LTDA')",
            "born_d": show("born", "d"), "born_i": show("born", "i"), "born_y": show("born", "y"), "issued_d": show("issued", "d"), "issued_i": show("issued", "i"),
            "issued_m": show("issued", "m"), "issued_n": show("issued", "n"), "ends_d": show("ends", "d"), "ends_i": show("ends", "i"), "ends_y": show("ends", "y"),
            "dv2": f"(asc_rest - CASE WHEN desc_rest = 10 THEN 2 ELSE 0 END + 11) % 11 % 10",
        },
        {
            "registration": f"concat(substr(cpf, 1, 9), CAST(desc_rest % 10 AS {s}), CAST(CAST(dv2 AS INT) AS {s}))",
            "number_check": digit("substr(cpf, 1, 9)", 9), "born_check": digit("born_y", 6), "ends_check": digit("ends_y", 6),
        },
        {"composed": "concat(substr(cpf, 1, 9), number_check, born_y, born_check, ends_y, ends_check)"},
        {
            "zone1": "concat('IDBRA', substr(cpf, 1, 9), number_check, '<<<<<<<<<<<<<<<')",
            "zone2": f"concat(born_y, born_check, 'M', ends_y, ends_check, 'BRA<<<<<<<<<<<', CAST({_sum('composed', composite)} % 10 AS {s}))",
            "zone3": "rpad(concat(family, '<<', given), 30, '<')",
        },
    ]


def people(t):
    df = add_numbers(spread(t.customer), "c_custkey")
    for stage in _person(True):
        df = df.withColumns({name: F.expr(text) for name, text in stage.items()})
    return df


def _people_sql() -> str:
    parts, source = [numbers_sql("customer", "c_custkey", "numbers")], "numbers"
    stages = _person(False)
    for number, stage in enumerate(stages):
        target = "people" if number == len(stages) - 1 else f"people_{number}"
        parts.append(f"{target} AS (SELECT *, " + ", ".join(f"{text} AS {name}" for name, text in stage.items()) + f" FROM {source})")
        source = target
    return ", ".join(parts)


PEOPLE = _people_sql()


def _q(text: str) -> str:
    return f"'{text}'"


# type -> lines: (page, left, top, width, text as SQL)
LAYOUT = {
    "BR_CPF_CARD": [
        (1, 50, 40, 300, _q("MINISTÉRIO DA FAZENDA")), (1, 50, 70, 300, _q("CADASTRO DE PESSOAS FÍSICAS")), (1, 50, 110, 200, _q("NÚMERO DE INSCRIÇÃO")),
        (1, 50, 140, 150, f"CASE WHEN c_custkey % 14 = 7 THEN {_dotted_cpf('cpf_bad')} ELSE {_dotted_cpf('cpf')} END"),
        (1, 50, 180, 60, _q("NOME")), (1, 50, 210, 200, "person"), (1, 50, 250, 120, _q("NASCIMENTO")), (1, 50, 280, 100, "born_d"),
    ],
    "BR_CNH": [
        (1, 50, 100, 260, _q("2e1 NOME E SOBRENOME")), (1, 50, 130, 60, "given"), (1, 120, 130, 100, "concat('DA ', family)"),
        (1, 50, 180, 80, _q("4d CPF")), (1, 300, 180, 150, _q("5 N REGISTRO")), (1, 600, 180, 120, _q("9 CAT. HAB.")),
        (1, 50, 210, 150, _dotted_cpf("cpf")), (1, 300, 210, 130, "registration"), (1, 600, 210, 40, _q("AB")),
        (1, 50, 260, 400, _q("3 DATA, LOCAL E UF DE NASCIMENTO")), (1, 600, 260, 150, _q("1ª HABILITAÇÃO")),
        (1, 50, 290, 250, "concat(born_d, ', SAO PAULO, SP')"), (1, 600, 290, 100, "issued_d"),
        (1, 50, 340, 160, _q("4a DATA EMISSAO")), (1, 300, 340, 120, _q("4b VALIDAOE")), (1, 50, 370, 100, "issued_d"), (1, 300, 370, 100, "ends_d"),
    ],
    "BR_CIN": [
        (1, 50, 100, 300, "concat('Nome: ', person)"), (1, 50, 130, 150, _q("REGISTRO GERAL")),
        (1, 50, 155, 120, "concat(substr(cpf, 1, 2), '.', substr(cpf, 3, 3), '.', substr(cpf, 6, 3), '-9')"),
        (1, 50, 200, 200, _q("DATA DE NASCIMENTO")), (1, 400, 200, 150, _q("NATURALIDADE")), (1, 50, 225, 100, "born_d"), (1, 400, 225, 150, _q("SÃO PAULO - SP")),
        (1, 50, 280, 100, _q("FILIAÇÃO")), (1, 50, 310, 200, "concat('JOSE DA ', family)"), (1, 50, 340, 200, "mother"),
        (1, 50, 390, 50, _q("CPF")), (1, 50, 420, 150, _dotted_cpf("cpf")),
        (1, 50, 470, 200, _q("DATA DE EXPEDIÇÃO")), (1, 400, 470, 120, _q("VALIDADE")), (1, 50, 495, 100, "issued_d"), (1, 400, 495, 100, "ends_d"),
        (2, 50, 100, 500, "zone1"), (2, 50, 130, 500, "zone2"), (2, 50, 160, 500, "zone3"),
    ],
    "BR_PROOF_OF_ADDRESS": [
        (1, 50, 60, 400, _q("CONTA DE ENERGIA ELÉTRICA")), (1, 50, 100, 300, "concat('CLIENTE: ', person)"), (1, 50, 130, 300, f"concat('CPF/CNPJ: ', {_dotted_cnpj('cnpj')})"),
        (1, 50, 160, 250, _q("Rua das Flores, 123")), (1, 50, 190, 350, "concat('CEP ', substr(cpf, 1, 5), '-', substr(cpf, 6, 3), ' SÃO PAULO - SP')"),
        (1, 50, 230, 120, _q("REFERÊNCIA")), (1, 400, 230, 120, _q("VENCIMENTO")), (1, 50, 255, 80, "issued_m"), (1, 400, 255, 100, "ends_d"),
        (1, 50, 310, 80, _q("BAIRRO")), (1, 50, 335, 80, _q("Centro")),
    ],
    "BR_CNPJ_CARD": [
        (1, 50, 60, 500, _q("CADASTRO NACIONAL DA PESSOA JURÍDICA")), (1, 50, 100, 200, _q("NÚMERO DE INSCRIÇÃO")), (1, 400, 100, 180, _q("DATA DE ABERTURA")),
        (1, 50, 125, 200, _dotted_cnpj("cnpj")), (1, 400, 125, 100, "issued_d"), (1, 50, 170, 200, _q("NOME EMPRESARIAL")), (1, 50, 195, 300, "company"),
        (1, 50, 240, 500, _q("CÓDIGO E DESCRIÇÃO DA ATIVIDADE ECONÔMICA PRINCIPAL")), (1, 50, 265, 450, _q("62.01-5-01 - Desenvolvimento de programas")),
        (1, 50, 310, 120, _q("LOGRADOURO")), (1, 400, 310, 80, _q("NÚMERO")), (1, 50, 335, 200, _q("RUA DAS FLORES")), (1, 400, 335, 50, "concat('N', CAST(c_custkey AS {s}))"),
        (1, 50, 380, 40, _q("CEP")), (1, 250, 380, 100, _q("MUNICÍPIO")), (1, 500, 380, 30, _q("UF")),
        (1, 50, 405, 100, "concat(substr(cpf, 1, 5), '-', substr(cpf, 6, 3))"), (1, 250, 405, 120, _q("SAO PAULO")), (1, 500, 405, 30, _q("SP")),
        (1, 50, 450, 200, _q("SITUAÇÃO CADASTRAL")), (1, 400, 450, 260, _q("DATA DA SITUAÇÃO CADASTRAL")), (1, 50, 475, 80, _q("ATIVA")), (1, 400, 475, 100, "issued_d"),
    ],
    "BR_CCMEI": [
        (1, 50, 60, 600, _q("CERTIFICADO DA CONDIÇÃO DE MICROEMPREENDEDOR INDIVIDUAL")), (1, 50, 100, 200, _q("NOME EMPRESARIAL")), (1, 50, 125, 300, "company"),
        (1, 50, 170, 60, _q("CNPJ")), (1, 50, 195, 200, _dotted_cnpj("cnpj")), (1, 50, 240, 150, _q("CAPITAL SOCIAL")), (1, 50, 265, 120, "concat('R$ 1.', lpad(CAST(c_custkey % 1000 AS {s}), 3, '0'), ',50')"),
        (1, 50, 310, 200, _q("OCUPAÇÃO PRINCIPAL")), (1, 50, 335, 150, _q("Cabeleireiro")),
        (1, 50, 380, 220, _q("ENDEREÇO COMERCIAL")), (1, 50, 405, 250, _q("Rua das Flores, 123")), (1, 50, 430, 350, "concat('CEP ', substr(cpf, 1, 5), '-', substr(cpf, 6, 3), ' SÃO PAULO - SP')"),
        (1, 50, 480, 220, _q("NOME DO EMPRESÁRIO")), (1, 50, 505, 200, "person"), (1, 50, 550, 50, _q("CPF")), (1, 50, 575, 150, _dotted_cpf("cpf")),
        (1, 50, 620, 200, _q("DATA DE NASCIMENTO")), (1, 50, 645, 100, "born_d"), (1, 50, 690, 180, _q("DATA DE EMISSÃO")), (1, 50, 715, 100, "issued_d"),
    ],
    "BR_SOCIAL_CONTRACT": [
        (1, 50, 40, 300, _q("CONTRATO SOCIAL")), (1, 50, 70, 900, "concat('A sociedade girará sob a denominação social de ', company, ', com sede na Rua das Flores, 123,')"),
        (1, 50, 100, 900, f"concat('bairro Centro, CEP ', substr(cpf, 1, 5), '-', substr(cpf, 6, 3), ', inscrita no CNPJ sob nº ', {_dotted_cnpj('cnpj')}, ', NIRE ', cpf, '.')"),
        (1, 50, 130, 900, _q("O objeto social será: comércio varejista de artigos. O capital social é de R$ 10.000,00")),
        (2, 50, 160, 900, f"concat('dividido entre João da Silva, brasileiro, casado, CPF ', {_dotted_cpf('cpf')}, ', e Ana Souza, brasileira, CPF ', {_dotted_cpf('cpf_bad')}, ' e')"),
        (2, 50, 190, 900, "concat('assinam em São Paulo, ', CAST(c_custkey % 28 + 1 AS {s}), ' de março de 2020.')"),
    ],
}

_CEP = "concat(substr(cpf, 1, 5), substr(cpf, 6, 3))"
_CEP_DASH = "concat(substr(cpf, 1, 5), '-', substr(cpf, 6, 3))"
# type -> path -> (status, normalized as SQL)
EXPECTED = {
    "BR_CPF_CARD": {"cpf": ("CASE WHEN c_custkey % 14 = 7 THEN 'INVALID' ELSE 'VALID' END", "CASE WHEN c_custkey % 14 <> 7 THEN cpf END"), "name": ("'VALID'", "person"), "birthDate": ("'VALID'", "born_i")},
    "BR_CNH": {
        "name": ("'VALID'", "person"), "cpf": ("'VALID'", "cpf"), "birthDate": ("'VALID'", "born_i"), "registrationNumber": ("'VALID'", "registration"), "category": ("'VALID'", "'AB'"),
        "firstLicenseDate": ("'VALID'", "issued_i"), "issueDate": ("'VALID'", "issued_i"), "expirationDate": ("'VALID'", "ends_i"),
    },
    "BR_CIN": {
        "name": ("'VALID'", "person"), "cpf": ("'VALID'", "cpf"), "rg": ("'VALID'", "concat(substr(cpf, 1, 8), '9')"), "birthDate": ("'VALID'", "born_i"), "issueDate": ("'VALID'", "issued_i"),
        "expirationDate": ("'VALID'", "ends_i"), "birthPlace": ("'VALID'", "'SAO PAULO - SP'"), "fatherName": ("'UNCERTAIN'", "concat('JOSE DA ', family)"), "motherName": ("'UNCERTAIN'", "mother"),
        "mrz": ("'VALID'", "concat(zone1, chr(10), zone2, chr(10), zone3)"),
    },
    "BR_PROOF_OF_ADDRESS": {
        "holderName": ("'VALID'", "person"), "holderDocument": ("'VALID'", "cnpj"), "addressLine": ("'UNCERTAIN'", "'RUA DAS FLORES, 123'"), "neighborhood": ("'VALID'", "'CENTRO'"),
        "city": ("'UNCERTAIN'", "'SAO PAULO'"), "state": ("'UNCERTAIN'", "'SP'"), "postalCode": (f"CASE WHEN {_CEP} = '00000000' THEN 'NOT_FOUND' ELSE 'VALID' END", _CEP),
        "referenceMonth": ("'VALID'", "issued_n"), "dueDate": ("'VALID'", "ends_i"), "serviceType": ("'VALID'", "'ELECTRICITY'"),
    },
    "BR_CNPJ_CARD": {
        "cnpj": ("'VALID'", "cnpj"), "openingDate": ("'VALID'", "issued_i"), "legalName": ("'VALID'", "company"), "tradeName": ("'NOT_FOUND'", "NULL"), "mainActivityCode": ("'VALID'", "'6201501'"),
        "mainActivityDescription": ("'VALID'", "'DESENVOLVIMENTO DE PROGRAMAS'"), "legalNature": ("'NOT_FOUND'", "NULL"), "street": ("'VALID'", "'RUA DAS FLORES'"), "number": ("'VALID'", "concat('N', CAST(c_custkey AS VARCHAR))"),
        "complement": ("'NOT_FOUND'", "NULL"), "postalCode": ("'VALID'", _CEP), "neighborhood": ("'NOT_FOUND'", "NULL"), "city": ("'VALID'", "'SAO PAULO'"), "state": ("'VALID'", "'SP'"),
        "registrationStatus": ("'VALID'", "'ATIVA'"), "registrationStatusDate": ("'VALID'", "issued_i"),
    },
    "BR_CCMEI": {
        "cnpj": ("'VALID'", "cnpj"), "legalName": ("'VALID'", "company"), "tradeName": ("'NOT_FOUND'", "NULL"), "openingDate": ("'NOT_FOUND'", "NULL"), "shareCapital": ("'VALID'", "concat('1', lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0'), '.50')"),
        "mainActivityCode": ("'NOT_FOUND'", "NULL"), "mainActivityDescription": ("'VALID'", "'CABELEIREIRO'"), "address": ("'VALID'", f"concat('RUA DAS FLORES, 123 CEP ', {_CEP_DASH}, ' SAO PAULO - SP')"),
        "postalCode": ("'VALID'", _CEP), "city": ("'VALID'", "'SAO PAULO'"), "state": ("'VALID'", "'SP'"), "holderName": ("'VALID'", "person"), "holderCpf": ("'VALID'", "cpf"), "holderBirthDate": ("'VALID'", "born_i"), "certificateDate": ("'VALID'", "issued_i"),
    },
    "BR_SOCIAL_CONTRACT": {
        "companyName": ("'VALID'", "company"), "cnpj": ("'VALID'", "cnpj"), "nire": ("'VALID'", "cpf"), "shareCapital": ("'VALID'", "'10000.00'"),
        "headquarters": ("'VALID'", f"concat('RUA DAS FLORES, 123, BAIRRO CENTRO, CEP ', {_CEP_DASH})"), "headquartersPostalCode": ("'VALID'", _CEP), "corporatePurpose": ("'VALID'", "'COMERCIO VAREJISTA DE ARTIGOS'"),
        "contractDate": ("'VALID'", "concat('2020-03-', lpad(CAST(c_custkey % 28 + 1 AS VARCHAR), 2, '0'))"), "partners[0].name": ("'VALID'", "'JOAO DA SILVA'"), "partners[0].cpf": ("'VALID'", "cpf"),
        "partners[1].name": ("'VALID'", "'ANA SOUZA'"), "partners[1].cpf": ("'INVALID'", "NULL"),
    },
}
EXPECTED_ROWS = "expected AS (" + " UNION ALL ".join(
    f"SELECT c_custkey AS doc_id, '{kind}' AS document_type, '{path}' AS path, {status} AS status, {value} AS normalized FROM people WHERE c_custkey % 7 = {TYPES.index(kind)}"
    for kind, fields in EXPECTED.items() for path, (status, value) in fields.items()
) + ")"


def captured_lines(t, kinds=TYPES):
    """Lines of all pages, in reading order, with boxes; the confidence falls with the line number."""
    shares = [TYPES.index(kind) for kind in kinds]
    kind = F.element_at(F.array(*[F.lit(k) for k in TYPES]), (F.col("c_custkey") % 7 + 1).cast("int"))
    pages = None
    for share in shares:
        rows = [
            f"struct({page} AS page, CAST({n} AS BIGINT) AS line_no, CAST({left} AS DOUBLE) AS left, CAST({top} AS DOUBLE) AS top, CAST({left + width} AS DOUBLE) AS right, CAST({top + 20} AS DOUBLE) AS bottom, {text.replace('{s}', 'STRING')} AS text)"
            for n, (page, left, top, width, text) in enumerate(LAYOUT[TYPES[share]])
        ]
        mine, printed = F.col("c_custkey") % 7 == share, F.expr(f"array({', '.join(rows)})")
        pages = F.when(mine, printed) if pages is None else pages.when(mine, printed)
    some = people(t).filter((F.col("c_custkey") % 7).isin(shares)) if len(shares) < len(TYPES) else people(t)
    out = some.select(F.col("c_custkey").alias("doc_id"), kind.alias("document_type"), F.explode_outer(pages).alias("l")).select("doc_id", "document_type", "l.*")
    confidence = (F.lit(0.99) - F.col("line_no") * 0.01).cast("decimal(5,4)")
    box = F.array("left", "top", "right", "top", "right", "bottom", "left", "bottom")
    # Captures are a stored table in real use; storing the derived one keeps its arithmetic out of every later plan.
    return cut_lineage(out.withColumns({"confidence": confidence, "bbox": box, "folded": fold(F.col("text"))}))


@query("extract_fields", f"WITH {PEOPLE}, {EXPECTED_ROWS} SELECT doc_id, document_type, path, status, normalized FROM expected")
def extract_fields(t):
    """All fields of all seven document types, from page lines with coordinates."""
    return ext.extract_fields(captured_lines(t), TODAY).select("doc_id", "document_type", "path", "status", "normalized")


@query(
    "extraction_reasons",
    f"WITH {PEOPLE}, {EXPECTED_ROWS} SELECT document_type, path, CASE WHEN status = 'VALID' THEN 'FOUND' WHEN status = 'INVALID' THEN 'VALIDATION_FAILED' WHEN status = 'UNCERTAIN' THEN 'VALUE_UNCERTAIN' WHEN path IN ('address') THEN 'PATTERN_NOT_FOUND' ELSE 'LABEL_NOT_FOUND' END AS reason, count(*) AS documents "
    "FROM expected WHERE document_type IN ('BR_CNPJ_CARD', 'BR_CNH') GROUP BY 1, 2, 3",
)
def extraction_reasons(t):
    """Why fields are as they are, counted."""
    explained = ext.diagnose(captured_lines(t, ("BR_CNPJ_CARD", "BR_CNH")), TODAY)
    return explained.groupBy("document_type", "path", "reason").agg(F.count(F.lit(1)).alias("documents"))


@query(
    "extraction_confidence",
    f"WITH {PEOPLE} SELECT c_custkey AS doc_id, 'br-cpf-card-1.0.0' AS extractor, CASE WHEN c_custkey % 14 = 7 THEN 0.79 ELSE 0.89 END AS overall_confidence FROM people WHERE c_custkey % 7 = 0",
)
def extraction_confidence(t):
    fields = ext.extract_fields(captured_lines(t, ("BR_CPF_CARD",)), TODAY)
    return ext.document_summary(fields).select("doc_id", "extractor", F.col("overall_confidence").cast("double").alias("overall_confidence"))


@query(
    "label_match",
    f"WITH {PEOPLE} SELECT c_custkey AS doc_id, u.line_no, u.label FROM people, LATERAL (SELECT * FROM (VALUES (0, 'NOME E SOBRENOME'), (3, 'CPF'), (4, 'N REGISTRO'), (5, 'CAT. HAB.'), (5, 'CAT. HAB'), (5, 'CAT HAB'), (9, 'DATA, LOCAL E UF DE NASCIMENTO'), (10, '1ª HABILITACAO'), (10, '1A HABILITACAO'), (10, '1 HABILITACAO'), (13, 'DATA EMISSAO'), (14, 'VALIDADE')) AS v(line_no, label)) AS u WHERE c_custkey % 7 = 1",
)
def label_match(t):
    """Which line carries which label: enumerators, accents and one wrong letter included."""
    matched = ext.matched_lines(captured_lines(t, ("BR_CNH",)))
    wanted = ("NOME E SOBRENOME", "CPF", "N REGISTRO", "CAT. HAB.", "CAT. HAB", "CAT HAB", "DATA, LOCAL E UF DE NASCIMENTO", "1ª HABILITACAO", "1A HABILITACAO", "1 HABILITACAO", "DATA EMISSAO", "VALIDADE")
    rows = matched.select("doc_id", F.col("line_no").cast("int").alias("line_no"), F.explode_outer("labels").alias("h")).filter("h IS NOT NULL")
    return rows.select("doc_id", "line_no", "h.label").filter(F.col("label").isin(*wanted))


@query(
    "field_candidates",
    f"WITH {PEOPLE} SELECT c_custkey AS doc_id, u.path, u.line_no, u.penalty FROM people, LATERAL (SELECT * FROM (VALUES ('registrationNumber', 7, 0.0), ('category', 8, 0.0), ('firstLicenseDate', 12, 0.0), ('name', 1, 0.0)) AS v(path, line_no, penalty)) AS u WHERE c_custkey % 7 = 1",
)
def field_candidates(t):
    """Values next to the labels of a few fields, nearest first, with their penalty."""
    candidates = lab.label_candidates(lab.page_neighbours(ext.matched_lines(captured_lines(t, ("BR_CNH",)))))
    rows = ext.field_candidates(candidates).filter(F.col("path").isin("registrationNumber", "category", "firstLicenseDate", "name") & (F.trim("text") != ""))
    return rows.select("doc_id", "path", F.col("line_no").cast("int").alias("line_no"), "penalty").distinct()


@query("mrz_zones", f"WITH {PEOPLE} SELECT c_custkey AS doc_id, substr(cpf, 1, 9) AS document_number, born_i AS birth_date, trim(replace(replace(zone3, '<<', ' / '), '<', ' ')) AS names, true AS fully_valid FROM people WHERE c_custkey % 7 = 2")
def mrz_zones(t):
    zones = ext.find_zones(captured_lines(t, ("BR_CIN",)), TODAY)
    return zones.select("doc_id", "reading.document_number", F.date_format("reading.birth_date", "yyyy-MM-dd").alias("birth_date"), "reading.names", fully_valid(F.col("reading")).alias("fully_valid"))


@query(
    "merged_rows",
    f"WITH {PEOPLE} SELECT c_custkey AS doc_id, count(*) AS n_rows FROM (SELECT c_custkey, unnest([100, 130, 180, 210, 260, 290, 340, 370]) AS top FROM people WHERE c_custkey % 7 = 1) GROUP BY 1",
)
def merged_rows(t):
    merged = layout.merge_rows(captured_lines(t, ("BR_CNH",)))
    return merged.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_rows"))


@query(
    "longest_name",
    f"WITH {PEOPLE} SELECT c_custkey AS doc_id, 'UNCERTAIN' AS status, CASE WHEN length(person) >= length(mother) THEN person ELSE mother END AS normalized FROM people WHERE c_custkey % 7 = 0",
)
def longest_name(t):
    """Cards whose name label was not read: the longest plausible name is taken."""
    card = captured_lines(t, ("BR_CPF_CARD",))
    no_label = card.filter(F.col("line_no") != 4)
    mother = people(t).select(F.col("c_custkey").alias("doc_id"), "mother")
    swapped = no_label.join(mother, "doc_id").withColumn("text", F.when(F.col("line_no") == 1, F.col("mother")).otherwise(F.col("text"))).drop("mother")
    lines = swapped.withColumn("folded", fold(F.col("text")))
    return ext.extract_fields(lines, TODAY).filter("path = 'name'").select("doc_id", "status", "normalized")


@query(
    "registered_extractor",
    "SELECT CAST(p_partkey AS BIGINT) AS doc_id, u.path, CASE WHEN u.path = 'maker' AND p_partkey % 3 = 0 THEN 'NOT_FOUND' ELSE 'VALID' END AS status, CASE WHEN u.path = 'brand' THEN p_brand WHEN p_partkey % 3 = 0 THEN NULL ELSE upper(p_type) END AS normalized "
    "FROM part, (VALUES ('brand'), ('maker')) AS u(path)",
)
def registered_extractor(t):
    """A type that is not read by label: its own function over its lines takes part in the one plan of all types."""
    def tags(lines, today):
        named = lines.select("doc_id", "page", "line_no", "text", F.col("confidence"), F.substring_index("text", "=", 1).alias("path"))
        value = F.substring_index("text", "=", -1)
        return named.filter(F.col("path").isin("brand", "maker")).withColumns({"raw": F.col("text"), "normalized": F.when(F.col("path") == "maker", F.upper(value)).otherwise(value), "status": F.lit("VALID"), "order": F.col("line_no")})

    printed = F.array_compact(F.array(F.concat(F.lit("brand="), "p_brand"), F.when(F.col("p_partkey") % 3 != 0, F.concat(F.lit("maker="), "p_type")), F.lit("brand=of a later line")))
    lines = spread(t.part).select(F.col("p_partkey").cast("bigint").alias("doc_id"), F.posexplode(printed).alias("line_no", "text")).select(
        "doc_id", F.lit("PART_TAG").alias("document_type"), F.lit(1).alias("page"), F.col("line_no").cast("bigint").alias("line_no"), "text", fold(F.col("text")).alias("folded"),
        F.lit(0.9).cast("decimal(5,4)").alias("confidence"), F.lit(None).cast("array<double>").alias("bbox"), *[F.lit(None).cast("double").alias(c) for c in ("left", "top", "right", "bottom")],
    )
    spec.register(spec.TypeSpec("PART_TAG", "part-tag-1", (), paths=("brand", "maker"), extract=tags))
    try:
        return ext.extract_fields(cut_lineage(lines), TODAY).select("doc_id", "path", "status", "normalized")
    finally:
        del spec.REGISTRY["PART_TAG"]
