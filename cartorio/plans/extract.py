"""Field extraction for all document types in one plan.

Lines become ranked alternatives (near a label, anywhere in the document, by shape), and the best
alternative per document and field is a grouped minimum. Documents of all types go through together.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cartorio.bounds import literal_table
from cartorio.functions import machine_zone as mrz
from cartorio.functions.dates import iso, parse_date, parse_long_date, parse_money, plausible
from cartorio.functions.expressions import bind, built_once, trim_chars
from cartorio.functions.folding import clean_person_name, fold, fold_chars
from cartorio.functions.offsets import cut_at
from cartorio.functions.check_digits import cep_normalize, cnpj_normalize, cnpj_valid, cpf_normalize, cpf_valid
from cartorio.operators.fields import CONFIDENCE, mean_confidence, policy
from cartorio.operators.labels import label_candidates, match_labels, page_neighbours
from cartorio.operators.layout import line_at, merge_rows, prose_index
from cartorio.operators.quality import CHECK_DIGIT_INVALID, CHECK_DIGIT_VALID, DATE_INVALID, DATE_VALID, FORMAT_VALID, POSTAL_CODE_VALID, STATE_VALID
from cartorio.plans import readers as r
from cartorio.plans import types as spec
from cartorio.session import cut_lineage
from cartorio.sources.lines import trim_blank

KEYS = ["doc_id", "document_type"]
ORDER = ["pass", "o1", "o2", "o3", "o4"]
ADDRESS_PATHS = ("address", "postalCode", "city", "state")
PARENT_PATHS = ("fatherName", "motherName")
#: Fields that are read in variants, such as ``holderDocument#cpf``.
VARIED_PATHS = ("holderDocument", "serviceType")
#: Labels of a block of lines, read as a whole.
BLOCK_READERS = {"BR_CIN": "PARENTS", "BR_CCMEI": "BUSINESS_ADDRESS"}
PLACE = "struct<line_no:bigint,confidence:double,bbox:array<double>,o1:bigint,o2:bigint>"
PAYLOAD = ["raw", "normalized", "status", "messages", "confidence", "page", "line_no", "bbox"]


def _types(*readers: str) -> list[str]:
    return [t.name for t in spec.REGISTRY.values() if any(f.reader in readers for f in t.fields)]


def _field_map() -> Column:
    """map<type|label, array<struct<path, reader, label_ord, minimum, kind>>>."""
    by_label: dict[str, list[str]] = {}
    for t in spec.REGISTRY.values():
        for f in t.fields:
            for ordinal, label in enumerate(f.labels):
                by_label.setdefault(f"{t.name}|{label}", []).append(
                    f"named_struct('path', '{f.path}', 'reader', '{f.reader}', 'label_ord', {ordinal}, 'minimum', {f.minimum}, 'kind', '{f.kind}')"
                )
        for label in t.block_labels:
            reader = BLOCK_READERS[t.name]
            by_label.setdefault(f"{t.name}|{label}", []).append(f"named_struct('path', '{reader}', 'reader', '{reader}', 'label_ord', 0, 'minimum', 0, 'kind', '')")
    return F.expr("map(" + ", ".join(f"'{key}', array({', '.join(rows)})" for key, rows in by_label.items()) + ")")


def matched_lines(lines: DataFrame) -> DataFrame:
    """Lines of documents whose fields are read by label, with the labels on them."""
    labelled = [t.name for t in spec.REGISTRY.values() if t.fields]
    chosen = lines.filter(F.col("document_type").isin(*labelled))
    return match_labels(
        chosen, {t.name: t.known_labels for t in spec.REGISTRY.values()}, {t.name: t.noise for t in spec.REGISTRY.values() if t.noise}
    )


def _labelled(candidates: DataFrame) -> DataFrame:
    """Candidates of label lines, once for every field, or block of fields, that uses the label; longer labels are not this label."""
    fields = F.try_element_at(_field_map(), F.concat_ws("|", "document_type", "label"))
    used = candidates.filter(~F.col("longer")).withColumn("f", F.explode(fields))
    return used.select("*", "f.*").drop("f")


def field_candidates(candidates: DataFrame) -> DataFrame:
    """Candidates of the fields that are read from one label and one value."""
    return _labelled(candidates).filter(~F.col("reader").isin(*BLOCK_READERS.values()))


def _at(items: Column, line_no: Column | None = None, confidence: Column | None = None, bbox: Column | None = None, o1: Column | None = None, o2: Column | None = None) -> Column:
    """Alternatives with the line that they are reported at and their order, where these are not those of the row."""
    given = {"line_no": line_no, "confidence": confidence, "bbox": bbox, "o1": o1, "o2": o2}
    kinds = {"confidence": "double", "bbox": "array<double>"}
    at = F.struct(*[(F.lit(None) if c is None else c).cast(kinds.get(n, "bigint")).alias(n) for n, c in given.items()])
    return F.transform(items.cast(f"array<{r.ALTERNATIVE}>"), lambda a: F.struct(a.alias("a"), at.alias("at")))


def _shape(df: DataFrame, items: Column, penalty: Column | float = 0.0, orders: dict[str, Column] | None = None) -> DataFrame:
    """Alternatives of an array column (see ``_at``), one row each, with the value policy applied.

    ``df`` carries page, line_no, confidence and bbox of the line a value is reported at, unless it says otherwise.
    """
    penalty = penalty if isinstance(penalty, Column) else F.lit(penalty)
    ranks = {o: (orders or {}).get(o, F.lit(0)).cast("bigint").alias(o) for o in ORDER[1:]}
    long = df.select(
        *KEYS, "page", "line_no", F.col("confidence").cast("double").alias("_c"), F.col("bbox").cast("array<double>").alias("bbox"), penalty.cast("double").alias("_p"),
        *ranks.values(), F.explode(items).alias("x"),
    ).filter("x.a IS NOT NULL")
    a, at = F.col("x.a"), F.col("x.at")
    # An alternative with a place of its own is reported there, whatever is known of the line.
    line_no, bbox = (F.when(at["line_no"].isNotNull(), at[c]).otherwise(F.col(c)) for c in ("line_no", "bbox"))
    confidence = F.when(at["line_no"].isNotNull(), at["confidence"]).otherwise(F.col("_c"))
    found = a["status"] != "NOT_FOUND"
    values = policy(confidence.cast("decimal(5,4)"), (F.col("_p") + a["extra"]).cast("decimal(5,4)"), a["status"], a["messages"], a["found"])
    return long.select(
        *KEYS, a["path"].alias("path"), a["pass"].alias("pass"), F.coalesce(at["o1"], "o1").alias("o1"), F.coalesce(at["o2"], "o2").alias("o2"), *ORDER[3:],
        a["raw"].alias("raw"), a["normalized"].alias("normalized"), values["status"].alias("status"), values["messages"].alias("messages"),
        F.when(found, values["confidence"]).cast(CONFIDENCE).alias("confidence"), F.when(found, F.col("page").cast("int")).alias("page"),
        F.when(found, line_no.cast("bigint")).alias("line_no"), F.when(found, bbox).alias("bbox"),
    )


# ---------------------------------------------------------------- by label


def label_alternatives(candidates: DataFrame, today: date) -> DataFrame:
    """Readings next to labels, and of the blocks under block labels, in one pass over the candidates."""
    block = F.col("reader").isin(*BLOCK_READERS.values())
    # A text without a digit is no value of most readers, and is left out before it is read.
    told = (F.trim("text") != "") & (~F.col("reader").isin(*r.DIGIT_READERS) | F.col("text").rlike("[0-9]"))
    usable = _labelled(candidates).filter(F.when(block, F.col("rank") == 0).otherwise(told))
    return _shape(usable, _label_readings(today), F.col("penalty"), {"o1": F.col("label_ord"), "o2": F.col("label_line"), "o3": F.col("rank")})


@built_once
def _label_readings(today: date) -> Column:
    single = r.read_candidate(F.col("reader"), F.col("path"), F.col("text"), F.col("following"), F.col("minimum"), F.col("kind"), today)
    return F.when(F.col("reader") == "PARENTS", _parents()).when(F.col("reader") == "BUSINESS_ADDRESS", _business_address()).otherwise(_at(single))


def _block_lines(first_text: Column) -> Column:
    """Lines of a block: what stands behind the label's colon, then the lines below it."""
    own = F.struct(first_text.alias("text"), F.col("line_no"), F.col("confidence").cast("double").alias("confidence"), F.col("bbox"))
    under = F.transform("following", lambda f: F.struct(F.trim(f["text"]).alias("text"), f["line_no"].alias("line_no"), f["confidence"].alias("confidence"), f["bbox"].alias("bbox")))
    return F.concat(F.array_compact(F.array(F.when(first_text != "", own))), under)


def _inline_text() -> Column:
    return F.when(F.col("line_text").contains(":"), r.after_colon(F.col("line_text")))


def _parents() -> Column:
    """Parents in the order they are printed under the filiation label."""
    def read(names: Column) -> Column:
        def one(position: int, path: str) -> Column:
            def item(n: Column) -> Column:
                found = r.alternative(path, 2, n["line"]["text"], n["name"], "UNCERTAIN", ["FILIATION_ORDER_ASSUMED"], 0.05, False)
                return _at(r.listed(F.when(n.isNotNull(), found).otherwise(r.missing(path, 2))), n["line"]["line_no"], n["line"]["confidence"], n["line"]["bbox"])

            return bind(F.get(names, F.lit(position)), item)

        both = F.concat(*[one(n, path) for n, path in enumerate(PARENT_PATHS)])
        return F.when(F.size(names) > 0, both).otherwise(F.slice(both, 1, 0))

    lines = F.transform(_block_lines(_inline_text()), lambda line: F.struct(line.alias("line"), clean_person_name(line["text"]).alias("name")))
    return bind(F.filter(lines, lambda n: n["name"].isNotNull()), read)


def _business_address() -> Column:
    """Address block of a certificate: the value behind the label and up to three lines below it."""
    def read(parts: Column) -> Column:
        first = F.get(parts, F.lit(0))
        raw = F.array_join(F.transform(parts, lambda p: p["text"]), " ")

        def whole(text: Column) -> Column:
            cep = r.first_match(text, r.POSTAL_CODE)
            code = F.when(cep_normalize(cep).isNotNull(), r.alternative("postalCode", 1, cep, cep_normalize(cep), messages=[POSTAL_CODE_VALID])).otherwise(r.missing("postalCode", 1))
            return _at(r.listed(r.alternative("address", 1, text, trim_chars(fold(text), " -:.,")), code), first["line_no"], first["confidence"], first["bbox"])

        cities = F.filter(F.transform(parts, lambda p: F.struct(r.city_and_state(fold(p["text"])).alias("v"), p.alias("p"))), lambda c: c["v"].isNotNull())

        def placed(c: Column) -> Column:
            there = c.isNotNull()
            both = r.listed(
                F.when(there, r.alternative("city", 1, c["v"]["city"], c["v"]["city"], extra=0.05)).otherwise(r.missing("city", 1)),
                F.when(there, r.alternative("state", 1, c["v"]["uf"], c["v"]["uf"], messages=[STATE_VALID], extra=0.05)).otherwise(r.missing("state", 1)),
            )
            return _at(both, c["p"]["line_no"], c["p"]["confidence"], c["p"]["bbox"])

        every = F.concat(bind(raw, whole), bind(F.get(cities, F.lit(0)), placed))
        return F.when(F.size(parts) > 0, every).otherwise(F.slice(every, 1, 0))

    return bind(_block_lines(_inline_text()), read)


# ---------------------------------------------------------------- anywhere in the document


def line_alternatives(lines: DataFrame, today: date) -> DataFrame:
    """Alternatives that need no label: numbers anywhere, postal codes, streets and cities by shape, services, a card's longest name."""
    kind, text, folded = F.col("document_type"), F.col("text"), F.col("folded")
    address = kind == "BR_PROOF_OF_ADDRESS"
    cpf_path = F.when(kind == "BR_CCMEI", "holderCpf").when(address, "holderDocument#cpf").otherwise("cpf")
    cnpj_path = F.when(address, "holderDocument#cnpj").otherwise("cnpj")
    cep = r.first_match(text, r.POSTAL_CODE)
    by_cep = F.when(
        cep_normalize(cep).isNotNull() & ~text.rlike(r.CPF),
        F.when(folded.contains("CEP"), r.alternative("postalCode", 2, cep, cep_normalize(cep), messages=[POSTAL_CODE_VALID], extra=0.05, found=False))
        .otherwise(r.alternative("postalCode", 2, cep, cep_normalize(cep), messages=[POSTAL_CODE_VALID], extra=r.FALLBACK)),
    )
    by_street = F.when(
        folded.rlike(r.STREET_START) & folded.rlike("[0-9]"),
        r.alternative("addressLine", 2, F.trim(text), folded, messages=["ADDRESS_BY_SHAPE"], extra=r.FALLBACK),
    )
    by_city = bind(r.city_and_state(folded), lambda c: r.listed(
        F.when(c.isNotNull(), r.alternative("city", 2, c["city"], c["city"], extra=r.FALLBACK)),
        F.when(c.isNotNull(), r.alternative("state", 2, c["uf"], c["uf"], messages=[STATE_VALID], extra=r.FALLBACK)),
    ))
    services = []
    for name, words in spec.SERVICES.items():
        test = F.lit(False)
        for word in words:
            test = test | folded.contains(word)
        services.append(F.when(test, r.alternative(f"serviceType#{name}", 2, F.trim(text), F.lit(name), messages=["SERVICE_TYPE_KEYWORD"], extra=0.10)))
    items = F.concat(
        F.when(kind.isin(*_types("CPF", "CPF_OR_CNPJ"), "BR_CPF_CARD"), r.anywhere_number(cpf_path, r.cpf_checked(text), True)).otherwise(r.listed()),
        F.when(kind.isin(*_types("CNPJ", "CPF_OR_CNPJ")), r.anywhere_number(cnpj_path, r.cnpj_checked(text), False)).otherwise(r.listed()),
        F.when(address, F.concat(r.listed(by_cep, by_street, *services), by_city)).otherwise(r.listed()),
    )
    card = kind == "BR_CPF_CARD"
    every = F.concat(_at(items), F.when(card, _card_shapes(today)).otherwise(F.array().cast(f"array<struct<a:{r.ALTERNATIVE},at:{PLACE}>>")))
    readable = [t.name for t in spec.REGISTRY.values() if t.fields] + ["BR_CPF_CARD"]
    # Numbers need a digit; a card's names and all that is read of an address need none.
    some = card | address | text.rlike("[0-9]")
    return _shape(lines.filter(kind.isin(*readable) & some), every, 0.0, {"o1": F.col("line_no")})


def _is_header(value: Column) -> Column:
    test = F.lit(False)
    for line in spec.CPF_CARD_HEADERS:
        test = test | value.contains(line) | F.contains(F.lit(line), value)
    return test


def _not_birth() -> Column:
    test = F.lit(False)
    for marker in spec.NOT_BIRTH_MARKERS:
        test = test | F.col("folded").contains(marker)
    return test


def _birth_dates(today: date) -> Column:
    dates = F.transform(r.matches(F.col("text"), r.DATE), lambda m: F.struct(m.alias("raw"), parse_date(m).alias("day")))
    return F.filter(dates, lambda d: F.coalesce(plausible(d["day"], F.lit("BIRTH"), today), F.lit(False)))


def _card_shapes(today: date) -> Column:
    """Readings of a card without its labels: the longest name, the earliest date."""
    text, folded = F.col("text"), F.col("folded")
    name = bind(clean_person_name(text), lambda n: _at(
        r.listed(F.when(n.isNotNull() & ~_is_header(folded) & ~_is_header(n), r.alternative("name", 2, text, n, "UNCERTAIN", extra=r.FALLBACK))),
        o1=-F.length(n), o2=F.col("line_no"),
    ))
    born = F.transform(_birth_dates(today), lambda d: F.get(_at(
        r.listed(r.alternative("birthDate", 2, d["raw"], iso(d["day"]), "UNCERTAIN", extra=r.FALLBACK)), o1=F.unix_date(d["day"]), o2=F.col("line_no")
    ), F.lit(0)))
    return F.concat(name, F.when(~_not_birth(), born).otherwise(F.slice(born, 1, 0)))


def cpf_card_alternatives(lines: DataFrame, today: date) -> DataFrame:
    """The card has its values on the label line or one of the two lines after it.

    Lines and what is asked of them meet as rows of one key, so the lines are read once.
    """
    card = lines.filter(F.col("document_type") == "BR_CPF_CARD")
    folded, text = F.col("folded"), F.col("text")
    has = lambda labels: F.exists(F.array(*[F.lit(l) for l in labels]), lambda l: F.contains(folded, l))
    fields = F.array_compact(F.array(*[F.when(has(labels), F.lit(path)) for path, labels in spec.CPF_CARD_LABELS.items()]))
    own = F.struct("page", "text", "folded", F.col("confidence").cast("double").alias("confidence"), F.col("bbox").cast("array<double>").alias("bbox"))
    sent = F.when(F.size("_fields") > 0, F.array(*[F.struct((F.col("line_no") + n).alias("line_no"), F.lit(None).alias("own"), F.struct(F.lit(n).alias("offset"), F.col("_fields").alias("fields")).alias("ask")) for n in range(3)]))
    kept = F.array(F.struct("line_no", own.alias("own"), F.lit(None).alias("ask")))
    kind = "array<struct<line_no:bigint,own:struct<page:int,text:string,folded:string,confidence:double,bbox:array<double>>,ask:struct<offset:int,fields:array<string>>>>"
    rows = card.withColumn("_fields", fields).select(*KEYS, F.explode(F.concat(kept.cast(kind), F.coalesce(sent.cast(kind), F.array().cast(kind)))).alias("m")).select(*KEYS, "m.*")
    met = rows.groupBy(*KEYS, "line_no").agg(F.max("own").alias("own"), F.collect_set("ask").alias("asks")).filter("own IS NOT NULL AND size(asks) > 0")
    near = met.select(*KEYS, "line_no", "own.*", F.explode("asks").alias("q")).select("*", "q.offset", F.explode("q.fields").alias("field"))

    rest = F.ltrim(F.substr(folded, F.lit(len("NOME") + 1)), F.lit(" :-"))
    bare = F.when(folded.startswith("NOME") & (rest != ""), rest).otherwise(text)
    born = F.get(_birth_dates(today), F.lit(0))
    items = (
        F.when(F.col("field") == "cpf", r.near_number("cpf", r.cpf_checked(text)))
        .when(F.col("field") == "name", bind(clean_person_name(bare), lambda n: r.listed(F.when(n.isNotNull() & ~_is_header(n), r.alternative("name", 1, F.trim(bare), n)))))
        .otherwise(bind(born, lambda b: r.listed(F.when(b.isNotNull() & ~_not_birth(), r.alternative("birthDate", 1, b["raw"], iso(b["day"]), messages=[DATE_VALID])))))
    )
    return _shape(near, _at(items), F.col("offset") * 0.05, {"o1": F.col("line_no") - F.col("offset"), "o2": F.col("offset")})


# ---------------------------------------------------------------- machine-readable zone


def find_zones(lines: DataFrame, today: date) -> DataFrame:
    """First three consecutive rows of a page that look like a zone, read; one row per document."""
    keys = (*KEYS, "page")
    rows = merge_rows(lines.filter(F.col("document_type") == "BR_CIN"), keys)
    zone = mrz.clean(F.col("text"))
    item = F.struct(
        "line_no", F.trim("text").alias("text"), zone.alias("zone"), mrz.looks_like(zone).alias("fits"), "confidence", "left", "top", "right", "bottom"
    )
    paged = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(item)).alias("_rows"))
    starts = F.filter(
        F.sequence(F.lit(0), F.greatest(F.size("_rows") - 3, F.lit(0))),
        lambda i: (i + 2 < F.size("_rows")) & F.get("_rows", i)["fits"] & F.get("_rows", i + 1)["fits"] & F.get("_rows", i + 2)["fits"],
    )
    found = paged.withColumn("_at", F.get(starts, F.lit(0))).filter(F.col("_at").isNotNull())
    block = found.withColumn("_block", F.slice("_rows", F.col("_at") + 1, F.lit(3)))
    first = block.groupBy(*KEYS).agg(F.min(F.struct("page", "_block")).alias("z"))
    repaired = {f"_z{i}": mrz.restore_fillers(F.get("z._block", F.lit(i))["zone"]) for i in range(3)}
    three = [F.col(c) for c in repaired]
    weakest = F.array_min(F.transform("z._block", lambda b, i: F.struct(F.coalesce(b["confidence"], F.lit(1)).cast("double").alias("c"), i.alias("i"), b.alias("b"))))["b"]
    return first.withColumns(repaired).select(
        *KEYS, F.col("z.page").alias("page"), F.array_join(F.transform("z._block", lambda b: b["text"]), "\n").alias("raw"),
        F.concat_ws("\n", *three).alias("zone"), mrz.reading(*three, today).alias("reading"), weakest.alias("w"),
    ).select("*", F.col("w.line_no").alias("line_no"), F.col("w.confidence").alias("confidence"), F.array("w.left", "w.top", "w.right", "w.top", "w.right", "w.bottom", "w.left", "w.bottom").alias("bbox")).drop("w")


def zone_alternatives(zones: DataFrame) -> DataFrame:
    """The zone as a field; its birth date is kept behind the value until it can be compared."""
    read = F.col("reading")
    born = F.coalesce(iso(F.col("reading.birth_date")), F.lit(""))
    valid = mrz.fully_valid(read)
    value = F.concat(F.col("zone"), F.lit("\u0001"), born)
    item = (
        F.when(read.isNull(), r.alternative("mrz", 1, F.col("raw"), None, "UNCERTAIN", ["MRZ_LENGTH_UNEXPECTED"], 0.10, False))
        .when(valid, r.alternative("mrz", 1, F.col("raw"), value, "VALID", ["MRZ_CHECK_VALID"], 0.0, False))
        .otherwise(r.alternative("mrz", 1, F.col("raw"), value, "INVALID", ["MRZ_CHECK_INVALID"], 0.0, False))
    )
    return _shape(zones, _at(r.listed(item)))


# ---------------------------------------------------------------- prose

_NAME = r"\p{Lu}[\p{L}'\-]+(?:\s+(?:d[aeo]s?|e|\p{Lu}[\p{L}'\-]+)){1,7}"
# How a contract words its parts. Each shape has the text before the value, the value, the text after it.
COMPANY = (r"((?:DENOMINACAO(?: SOCIAL)?|NOME EMPRESARIAL|RAZAO SOCIAL|FIRMA)\s+(?:DE\s+|DA\s+|DO\s+)?)", r"((?:[A-Z0-9&'\-]+\s+){1,8}?(?:LTDA\.?|EIRELI|SLU|EPP|S/A|S\.A\.?))", r"((?![A-Z]))")
NIRE = (r"(NIRE\s*(?:N[O°º.]*\s*)?:?\s*)", r"([0-9]{11})", r"((?![0-9]))")
CAPITAL = (r"(CAPITAL SOCIAL[^R0-9]{0,120}?)", r"(R\$\s?[0-9]{1,3}(?:\.[0-9]{3})*,[0-9]{2})", r"()")
SEAT = (r"(SEDE\s+(?:SOCIAL\s+)?(?:NA|NO|EM|A)\s+)", r"((?:RUA|AVENIDA|AV\.?|ALAMEDA|TRAVESSA|PRACA|RODOVIA|ESTRADA)\b.{5,220}?CEP\s*[N°º.]*\s*[0-9]{2}\.?[0-9]{3}-?[0-9]{3})", r"()")
PURPOSE = (r"(OBJETO(?: SOCIAL)?(?: DA SOCIEDADE)?\s+(?:SERA|SERAO|E)\s*:?\s*)", r"(.{10,300}?)", r"((?<![0-9])\.\s)")
LONG_DATE = (r"((?<![0-9]))", r"([0-9]{1,2}\s+DE\s+[A-Z]{4,9}\s+DE\s+[0-9]{4})", r"((?![0-9]))")
PARTNER = (r"((?<!\p{Ll}))", f"({_NAME})", r"(,\s+)(?=brasileir|portugu|estrangeir|natural|casad|solteir|divorciad|vi[uú]v|empres[aá]ri|maior|nascid)")
COMPANY_NUMBER = ("((?<![0-9A-Za-z]))", r"((?:[0-9A-Za-z]{2}\.\s?[0-9A-Za-z]{3}\.\s?[0-9A-Za-z]{3}\s?/\s?[0-9A-Za-z]{4}\s?-\s?[0-9]{2}|[0-9]{14}))", "((?![0-9A-Za-z]))")


def first_located(text: Column, shape: tuple[str, str, str]) -> Column:
    """struct<at, value> of the first match of a shape; null without one. Nothing behind it is looked at."""
    pattern = "".join(shape)
    before, value = (F.regexp_extract(text, pattern, n) for n in (1, 2))
    found = lambda v: F.when(v != "", F.struct((F.length(F.get(F.split(text, pattern, 2), F.lit(0))) + F.length(before)).alias("at"), v.alias("value")))
    return bind(value, found)


def located(text: Column, shape: tuple[str, str, str]) -> Column:
    """array<struct<at, value, rest>>: every match of a shape with its 0-based offset and the text up to the next value."""
    pattern = "".join(shape)
    group = lambda n: F.regexp_extract_all(text, F.lit(pattern), F.lit(n))
    # What only looks behind has no text of its own.
    if shape[0].startswith("((?<"):
        whole = F.transform(group(2), lambda value: F.struct(F.lit("").alias("before"), value.alias("value")))
    else:
        whole = F.zip_with(group(1), group(2), lambda before, value: F.struct(before.alias("before"), value.alias("value")))
    parts = F.arrays_zip(cut_at(text, pattern).alias("cut"), whole.alias("shape"))

    def rows(cuts: Column) -> Column:
        def step(s: Column, p: Column) -> Column:
            start = s["end"] + F.length(p["cut"]["gap"])
            value = F.struct((start + F.length(p["shape"]["before"])).alias("at"), p["shape"]["value"].alias("value"))
            return F.struct((start + F.length(p["cut"]["match"])).alias("end"), F.concat(s["out"], F.array(value)).alias("out"))

        start = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<at:int,value:string>>").alias("out"))
        return F.aggregate(F.filter(cuts, lambda p: p["cut"]["match"].isNotNull()), start, step, lambda s: s["out"])

    def rested(found: Column) -> Column:
        def one(m: Column, n: Column) -> Column:
            begin = m["at"] + F.length(m["value"])
            stop = F.coalesce(F.get(found, n + 1)["at"], F.length(text))
            return F.struct(m["at"].alias("at"), m["value"].alias("value"), F.substr(text, begin + 1, stop - begin).alias("rest"))

        return F.transform(found, one)

    return bind(bind(parts, rows), rested)


def _collapse(value: Column) -> Column:
    return trim_chars(F.regexp_replace(trim_blank(value), rf"{r.S}+", " "), " ,;.")


@built_once
def _contract_readings(today: date) -> Column:
    """Alternatives in the running text of a contract, with the line that each is reported at."""
    original, plain, starts = F.col("prose"), F.col("plain"), F.col("starts")
    out_of = lambda item: F.substr(original, item["at"] + 1, F.length(item["value"]))

    def first_of(shape, build):
        return bind(first_located(plain, shape), lambda m: F.when(m.isNotNull(), build(m)))

    row = lambda alt, at: F.struct(alt.alias("a"), F.lit(None).cast("bigint").alias("n") if at is None else line_at(starts, at).alias("n"))
    company = first_of(COMPANY, lambda m: row(r.alternative("companyName", 1, _collapse(out_of(m)), _collapse(m["value"])), m["at"]))
    nire = first_of(NIRE, lambda m: row(r.alternative("nire", 1, out_of(m), m["value"], messages=[FORMAT_VALID]), m["at"]))
    capital = first_of(CAPITAL, lambda m: row(r.alternative("shareCapital", 1, out_of(m), parse_money(m["value"]), messages=[FORMAT_VALID]), m["at"]))
    seat = lambda m: row(r.alternative("headquarters", 1, _collapse(out_of(m)), _collapse(m["value"])), m["at"])
    last_cep = lambda m: F.try_element_at(r.matches(_collapse(m["value"]), r.POSTAL_CODE), F.lit(-1))
    seat_cep = lambda m: (bind(last_cep(m), lambda c: F.when(cep_normalize(c).isNotNull(), row(r.alternative("headquartersPostalCode", 1, c, cep_normalize(c), messages=[POSTAL_CODE_VALID]), m["at"]))))
    seats = first_of(SEAT, lambda m: F.array(seat(m), seat_cep(m)))
    purpose = first_of(PURPOSE, lambda m: row(r.alternative("corporatePurpose", 1, _collapse(out_of(m)), _collapse(m["value"])), m["at"]))

    def dated(m: Column) -> Column:
        day = parse_long_date(m["value"])
        right = F.coalesce(plausible(day, F.lit("ISSUE"), today), F.lit(False))
        return row(
            F.when(right, r.alternative("contractDate", 1, out_of(m), iso(day), messages=[DATE_VALID])).otherwise(
                r.alternative("contractDate", 1, out_of(m), None, "INVALID", [DATE_INVALID], r.FALLBACK, False)
            ),
            m["at"],
        )

    signed = bind(F.try_element_at(located(plain, LONG_DATE), F.lit(-1)), lambda m: F.when(m.isNotNull(), dated(m)))

    def numbered(items: Column) -> Column:
        def judge(m: Column) -> Column:
            low = F.greatest(m["at"] - spec.ANCHOR_REACH, F.lit(0))
            near = F.contains(F.substr(plain, low + 1, m["at"] - low), F.lit("CNPJ"))

            def rated(v: Column) -> Column:
                normal, good = v["normal"], v["good"]
                return (
                    F.when(good & near, r.alternative("cnpj", 1, m["value"], normal, messages=[CHECK_DIGIT_VALID]))
                    .when(good, r.alternative("cnpj", 2, m["value"], normal, messages=[CHECK_DIGIT_VALID], extra=r.FALLBACK))
                    .when(normal.isNotNull() & near, r.alternative("cnpj", 3, m["value"], None, "INVALID", [CHECK_DIGIT_INVALID], r.FALLBACK, False))
                )

            judged = bind(cnpj_normalize(m["value"]), lambda n: F.struct(n.alias("normal"), (n.isNotNull() & cnpj_valid(n)).alias("good")))
            return bind(bind(judged, rated), lambda alt: F.when(alt.isNotNull(), row(alt, m["at"])))

        ranked = F.transform(items, lambda m, i: judge(m))
        return F.array_compact(ranked)

    def partners(items: Column) -> Column:
        named = F.filter(F.transform(items, lambda m: F.struct(clean_person_name(m["value"]).alias("name"), m.alias("m"))), lambda p: p["name"].isNotNull())
        first = bind(named, lambda ps: F.slice(F.filter(ps, lambda p, i: ~F.exists(F.slice(ps, 1, i), lambda q: q["name"] == p["name"])), 1, spec.MAX_PARTNERS))

        def two(p: Column, i: Column) -> Column:
            m, path = p["m"], F.concat(F.lit("partners["), i.cast("string"), F.lit("]."))
            behind = F.regexp_replace(m["rest"], r"^,\s+", "")

            def numbered(raw: Column, normal: Column) -> Column:
                return (
                    F.when(normal.isNull(), r.missing(F.concat(path, F.lit("cpf")), 1))
                    .when(cpf_valid(normal), r.alternative(F.concat(path, F.lit("cpf")), 1, raw, normal, messages=[CHECK_DIGIT_VALID]))
                    .otherwise(r.alternative(F.concat(path, F.lit("cpf")), 1, raw, None, "INVALID", [CHECK_DIGIT_INVALID], r.FALLBACK, False))
                )

            def read(rest: Column) -> Column:
                after, begin = F.substring(rest, 1, spec.CPF_WINDOW), m["at"] + F.length(m["value"]) + F.length(m["rest"]) - F.length(rest)
                return bind(r.first_match(after, r.CPF), lambda raw: F.array(
                    row(r.alternative(F.concat(path, F.lit("name")), 1, _collapse(m["value"]), p["name"]), m["at"]),
                    row(bind(cpf_normalize(raw), lambda normal: numbered(raw, normal)), begin + F.coalesce(F.instr(after, raw) - 1, F.lit(0))),
                ))

            return bind(behind, read)

        return F.flatten(F.transform(first, two))

    single = bind(seats, lambda both: F.array_compact(F.array(company, nire, capital, F.get(both, F.lit(0)), F.get(both, F.lit(1)), purpose, signed)))
    numbers = bind(located(original, COMPANY_NUMBER), numbered)
    people = bind(located(original, PARTNER), partners)
    kind = f"array<struct<a:{r.ALTERNATIVE},n:bigint>>"
    return F.concat(single.cast(kind), numbers.cast(kind), people.cast(kind))


def contract_alternatives(lines: DataFrame, today: date) -> DataFrame:
    """Fields of a company contract, read from its running text."""
    mine = lines.filter(F.col("document_type") == "BR_SOCIAL_CONTRACT")
    prose = prose_index(mine, "doc_id").withColumn("plain", fold_chars(F.col("prose")))
    long = prose.select("doc_id", F.posexplode_outer(_contract_readings(today)).alias("ordinal", "x")).filter("x IS NOT NULL")
    at = mine.select(*KEYS, "page", "line_no", "confidence", "bbox")
    joined = long.select("doc_id", "ordinal", "x.a", F.col("x.n").alias("line_no")).join(at, ["doc_id", "line_no"])
    return _shape(joined, _at(F.array("a")), 0.0, {"o1": F.col("ordinal")})


# ---------------------------------------------------------------- choice


def _paths(spark: SparkSession) -> DataFrame:
    rows = [(t.name, path) for t in spec.REGISTRY.values() for path in t.all_paths]
    return F.broadcast(literal_table(spark, rows, "document_type string, path string"))


def _best(variant: str | None) -> Column:
    """Aggregate: the alternative with the smallest order, of one variant of a field."""
    value = F.struct(*ORDER, *PAYLOAD)
    mine = F.col("variant").isNull() if variant is None else F.col("variant") == variant
    return F.min(F.when(mine, value))


def leading(alternatives: DataFrame) -> DataFrame:
    """The best alternative of every field, or variant of one, of a document: a minimum, reduced before it is shuffled."""
    value = F.struct(*ORDER, *PAYLOAD)
    return alternatives.groupBy(*KEYS, "path").agg(F.min(value).alias("v")).select(*KEYS, "path", "v.*")


def choose(alternatives: DataFrame) -> DataFrame:
    """Best alternative per document and field: one grouped minimum, reduced before it is shuffled.

    Only fields with variants have more than one minimum; they are few, and chosen apart from the others.
    """
    varied = F.col("path").contains("#") | F.col("path").isin(*VARIED_PATHS)
    plain = leading(alternatives.filter(~varied)).select(*KEYS, "path", *PAYLOAD)
    return plain.unionByName(_choose_variant(alternatives.filter(varied)))


def _choose_variant(alternatives: DataFrame) -> DataFrame:
    """Of a field with variants, the one whose best alternative counts."""
    named = alternatives.withColumns({"variant": F.get(F.split("path", "#"), F.lit(1)), "path": F.substring_index("path", "#", 1)})
    variants = ("cnpj", "cpf", *spec.SERVICES)
    best = named.groupBy(*KEYS, "path").agg(_best(None).alias("main"), *[_best(v).alias(v) for v in variants])
    number = F.coalesce(*[F.when(F.col(f"{v}.status") == s, F.col(v)) for s in ("VALID", "INVALID", "UNCERTAIN") for v in ("cnpj", "cpf")])
    hits = F.array_compact(F.array(*[F.col(v) for v in spec.SERVICES]))
    unclear = F.struct(
        *[F.get(hits, F.lit(0))[c].alias(c) for c in (*ORDER, "raw")], F.lit(None).cast("string").alias("normalized"), F.lit("UNCERTAIN").alias("status"),
        F.array(F.lit("SERVICE_TYPE_AMBIGUOUS")).alias("messages"), *[F.get(hits, F.lit(0))[c].alias(c) for c in PAYLOAD[4:]],
    )
    service = F.when(F.size(hits) == 1, F.get(hits, F.lit(0))).when(F.size(hits) > 1, unclear)
    chosen = F.coalesce(F.when(F.col("path") == "holderDocument", number), F.when(F.col("path") == "serviceType", service), F.col("main"))
    return best.withColumn("_c", chosen).select(*KEYS, "path", *[F.col(f"_c.{c}").alias(c) for c in PAYLOAD])


def _compare_zone(fields: DataFrame) -> DataFrame:
    """The birth date of a zone against the printed one; mrz values lose the date they carried."""
    birth = F.when((F.col("document_type") == "BR_CIN") & (F.col("path") == "birthDate") & (F.col("status") == "VALID"), F.col("normalized"))
    # A document has a few dozen fields at most, so a window per document stays small.
    joined = fields.withColumn("_printed", F.max(birth).over(Window.partitionBy("doc_id")))
    is_zone = (F.col("path") == "mrz") & F.col("normalized").isNotNull()
    date_ = F.substring_index("normalized", "\u0001", -1)
    compared = is_zone & F.col("_printed").isNotNull() & (date_ != "")
    same = date_ == F.col("_printed")
    code = F.when(same, "MRZ_BIRTH_DATE_MATCH").otherwise("MRZ_BIRTH_DATE_MISMATCH")
    return joined.withColumns(
        {
            "status": F.when(compared & ~same & (F.col("status") == "VALID"), "UNCERTAIN").otherwise(F.col("status")),
            "messages": F.when(compared, F.concat("messages", F.array(code))).otherwise(F.col("messages")),
            "normalized": F.when(is_zone, F.substring_index("normalized", "\u0001", 1)).otherwise(F.col("normalized")),
        }
    ).drop("_printed")


def extract_fields(lines: DataFrame, today: date, candidates: DataFrame | None = None) -> DataFrame:
    """Fields of all documents with a registered type.

    Lines: doc_id, document_type, page, line_no (running), text, folded, confidence, bbox, left, top, right, bottom.
    ``candidates`` is the frame of ``label_candidates`` of these lines, where it is known.
    """
    known = lines.filter(F.col("document_type").isin(*spec.REGISTRY))
    if candidates is None:
        candidates = label_candidates(page_neighbours(matched_lines(known)))
    zero = {"pass": F.lit(99)} | {o: F.lit(0).cast("bigint") for o in ORDER[1:]}
    expected = cut_lineage(known.select(*KEYS).distinct()).join(_paths(lines.sparkSession), "document_type")
    nothing = expected.select(
        *KEYS, "path", *[c.alias(n) for n, c in zero.items()], F.lit(None).cast("string").alias("raw"), F.lit(None).cast("string").alias("normalized"),
        F.lit("NOT_FOUND").alias("status"), F.array().cast("array<string>").alias("messages"), F.lit(None).cast(CONFIDENCE).alias("confidence"),
        F.lit(None).cast("int").alias("page"), F.lit(None).cast("bigint").alias("line_no"), F.lit(None).cast("array<double>").alias("bbox"),
    )
    parts = [
        label_alternatives(candidates, today), line_alternatives(known, today), cpf_card_alternatives(known, today), zone_alternatives(find_zones(known, today)), contract_alternatives(known, today),
        *registered_alternatives(known, today),
    ]
    every = nothing
    for part in parts:
        # A way of reading is a job of its own that leaves a row per field: smaller plans, and less to repeat after a loss.
        every = every.unionByName(cut_lineage(leading(part)))
    # Only identity cards have a zone to compare, so the fields of other types need no window.
    zoned = F.col("document_type") == "BR_CIN"
    return _compare_zone(choose(every.filter(zoned))).unionByName(choose(every.filter(~zoned)))


def registered_alternatives(lines: DataFrame, today: date) -> list[DataFrame]:
    """Alternatives of the types that bring an extractor of their own, each from its own lines."""
    kinds = {"raw": "string", "normalized": "string", "status": "string", "messages": "array<string>", "confidence": CONFIDENCE, "page": "int", "line_no": "bigint", "bbox": "array<double>"}
    found = []
    for t in spec.REGISTRY.values():
        if t.extract:
            rows = t.extract(lines.filter(F.col("document_type") == t.name), today)
            given = {c: F.col(c).cast(kind) if c in rows.columns else F.lit(None).cast(kind) for c, kind in kinds.items()}
            given["messages"] = F.coalesce(given["messages"], F.array().cast("array<string>"))
            order = F.col("order").cast("bigint") if "order" in rows.columns else F.lit(0).cast("bigint")
            zero = [F.lit(0).cast("bigint").alias(o) for o in ORDER[2:]]
            found.append(rows.select("doc_id", F.lit(t.name).alias("document_type"), "path", F.lit(1).alias("pass"), order.alias("o1"), *zero, *[c.alias(n) for n, c in given.items()]))
    return found


def document_summary(fields: DataFrame) -> DataFrame:
    """Version, schema version and overall confidence per extracted document."""
    rows = [(t.name, t.version, t.schema_version) for t in spec.REGISTRY.values()]
    versions = literal_table(fields.sparkSession, rows, "document_type string, extractor string, schema_version int")
    summed = fields.groupBy(*KEYS).agg(mean_confidence(F.col("confidence")).alias("overall_confidence"))
    return summed.join(F.broadcast(versions), "document_type")


# ---------------------------------------------------------------- explanation


def explain_extraction(fields: DataFrame, candidates: DataFrame, recorded: DataFrame | None = None, kept: int = 12) -> DataFrame:
    """Why a field is as it is: a reason, the label lines, all candidates counted and the first few kept.

    ``candidates`` is the frame of ``label_candidates``; ``recorded`` (doc_id, path, recorded_status)
    puts the stored status beside today's.
    """
    known = [(t.name, f.path, ", ".join(f.labels)) for t in spec.REGISTRY.values() for f in t.fields]
    known += [(t.name, "mainActivityDescription", ", ".join(f.labels)) for t in spec.REGISTRY.values() for f in t.fields if f.reader == "ACTIVITY"]
    known += [("BR_CCMEI", path, ", ".join(spec.CCMEI.block_labels)) for path in ADDRESS_PATHS]
    known = [(kind, path, ", ".join((labels, *spec.CIN.block_labels)) if kind == "BR_CIN" and path in PARENT_PATHS else labels) for kind, path, labels in known]
    tried = literal_table(fields.sparkSession, known, "document_type string, path string, labels string")
    rows = field_candidates(candidates)
    twin = rows.filter(F.col("reader") == "ACTIVITY").withColumn("path", F.lit("mainActivityDescription"))
    columns = ["doc_id", "path", "label_ord", "label_line", "rank", "line_no", "text", "penalty"]
    # Labels of a block count as searched, the lines under them are no candidates of their own.
    paths = F.when((F.col("document_type") == "BR_CCMEI") & F.col("label").isin(*spec.CCMEI.block_labels), F.array(*[F.lit(p) for p in ADDRESS_PATHS])).when(
        (F.col("document_type") == "BR_CIN") & F.col("label").isin(*spec.CIN.block_labels), F.array(*[F.lit(p) for p in PARENT_PATHS])
    )
    block = candidates.filter(F.col("rank") == 0).withColumn("path", F.explode_outer(paths)).filter("path IS NOT NULL")
    block = block.withColumns({"label_ord": F.lit(99), "text": F.lit(None).cast("string")})
    rows = rows.select(*columns).unionByName(twin.select(*columns)).unionByName(block.select(*columns))
    usable = F.trim("text") != ""
    seen = F.when(usable, F.struct("label_ord", "label_line", "rank", "line_no", "text", "penalty"))
    distinct = rows.groupBy("doc_id", "path", F.col("line_no"), F.col("text")).agg(F.min(seen).alias("_seen"), F.collect_set("label_line").alias("_lines"))
    summed = distinct.groupBy("doc_id", "path").agg(
        F.count("_seen").alias("candidate_count"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("_lines")))).alias("label_lines"),
        F.slice(F.sort_array(F.collect_list("_seen")), 1, kept).alias("first_candidates"),
    )
    joined = fields.join(F.broadcast(tried), ["document_type", "path"], "left").join(summed, ["doc_id", "path"], "left")
    count = F.coalesce("candidate_count", F.lit(0))
    weak = F.array_contains("messages", "NO_LABEL_NEARBY")
    reason = (
        F.when((F.col("status") == "VALID") & weak, "FOUND_WITHOUT_LABEL").when(F.col("status") == "VALID", "FOUND")
        .when(F.col("status") == "INVALID", "VALIDATION_FAILED").when(F.col("status") == "UNCERTAIN", "VALUE_UNCERTAIN")
        .when(F.col("labels").isNull(), "PATTERN_NOT_FOUND").when(F.col("label_lines").isNull(), "LABEL_NOT_FOUND")
        .when(count == 0, "VALUE_EMPTY").otherwise("VALUE_REJECTED")
    )
    codes = F.when(F.size("messages") > 0, F.array_join("messages", ", ")).otherwise("no detail")
    where = F.concat(F.lit("The label was found on line "), F.array_join(F.col("label_lines").cast("array<string>"), ", "))
    sentence = (
        F.when(F.col("reason") == "FOUND", "The value was read.")
        .when(F.col("reason") == "FOUND_WITHOUT_LABEL", "The value was found, but no label was next to it, so the confidence is lower.")
        .when(F.col("reason") == "VALIDATION_FAILED", F.concat(F.lit("A value was read but failed validation: "), codes, F.lit(". The value as read is kept in raw.")))
        .when(F.col("reason") == "VALUE_UNCERTAIN", F.concat(F.lit("A value was read, but the reading is an assumption: "), codes, F.lit(".")))
        .when(F.col("reason") == "PATTERN_NOT_FOUND", "This field is not read by label, and its pattern was not found in the text.")
        .when(F.col("reason") == "LABEL_NOT_FOUND", F.concat(F.lit("None of the labels was found in the text: "), F.col("labels"), F.lit(".")))
        .when(F.col("reason") == "VALUE_EMPTY", F.concat(where, F.lit(", but no value was next to it, to its right or below it.")))
        .otherwise(F.concat(where, F.lit(" and "), count.cast("string"), F.lit(" candidate value(s) were examined, but none had the expected format.")))
    )
    explained = joined.withColumn("reason", reason).withColumns({"explanation": sentence, "candidate_count": count})
    if recorded is not None:
        explained = explained.join(recorded, ["doc_id", "path"], "left")
    return explained


def diagnose(lines: DataFrame, today: date, recorded: DataFrame | None = None) -> DataFrame:
    """Fields of documents together with their explanation.

    What stands around labels is worked out once and stored: fields and their explanation both read it.
    """
    known = lines.filter(F.col("document_type").isin(*spec.REGISTRY))
    candidates = label_candidates(cut_lineage(page_neighbours(matched_lines(known))))
    return explain_extraction(extract_fields(known, today, candidates), candidates, recorded)
