"""Personal data in text lines: findings, consistent masks, residual check."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartorio.bounds import catalogue_rows, hint_small
from cartorio.functions.offsets import replace_matches
from cartorio.functions.check_digits import cnh_valid, cnpj_valid, cpf_valid, voter_valid
from cartorio.functions.expressions import bind, first_case
from cartorio.functions.folding import fold_compat
from cartorio.functions.pieces import piece_list, pieces_in
from cartorio.operators.classify import contains_join, grams

# Shapes that are looked for, and the names findings are reported under.
CPF_FORMATTED = r"[0-9]{3}\.[0-9]{3}\.[0-9]{3}-[0-9]{2}"
CPF_BARE = r"(?<![0-9.])[0-9]{11}(?![0-9.])"
CNPJ_FORMATTED = r"[0-9]{2}\.[0-9]{3}\.[0-9]{3}/[0-9]{4}-[0-9]{2}"
CNPJ_BARE = r"(?<![0-9.])[0-9]{14}(?![0-9.])"
CEP_FORMATTED = r"(?<![0-9])[0-9]{5}-[0-9]{3}(?![0-9])"
RG_FORMATTED = r"(?<![0-9])[0-9]{1,2}\.[0-9]{3}\.[0-9]{3}-[0-9Xx](?![0-9])"
VOTER_BARE = r"(?<![0-9.])[0-9]{12}(?![0-9.])"
KIND_CPF, KIND_CNPJ, KIND_CEP, KIND_RG = "CPF", "CNPJ", "CEP", "RG"
KIND_CNH, KIND_VOTER, KIND_NAME = "registro de CNH", "titulo de eleitor", "nome real"
MONTHS = "janeiro|fevereiro|março|abril|maio|junho|julho|agosto|setembro|outubro|novembro|dezembro"

# Scan order: (shape, kinds it may report, group of the allow-list it is checked against).
_SCANS = (
    (CPF_FORMATTED, "ELEVEN", "CPF/CNH"),
    (CPF_BARE, "ELEVEN", "CPF/CNH"),
    (CNPJ_FORMATTED, KIND_CNPJ, KIND_CNPJ),
    (CNPJ_BARE, KIND_CNPJ, KIND_CNPJ),
    (VOTER_BARE, KIND_VOTER, KIND_VOTER),
    (CEP_FORMATTED, KIND_CEP, KIND_CEP),
    (RG_FORMATTED, KIND_RG, KIND_RG),
)
NAME_CONSTANTS = 20
# A line without such a run of digits cannot hold any of the shapes.
ANY_DIGITS = "[0-9]{3}"


def digits_of(raw: Column) -> Column:
    return F.regexp_replace(raw, "[^0-9]", "")


def _kind(scan: str, digits: Column) -> Column:
    if scan == "ELEVEN":
        return first_case([(cpf_valid(digits), KIND_CPF), (cnh_valid(digits), KIND_CNH)])
    if scan == KIND_CNPJ:
        return F.when(cnpj_valid(digits), KIND_CNPJ)
    if scan == KIND_VOTER:
        return F.when(voter_valid(digits), KIND_VOTER)
    return F.lit(scan)


def find_values(lines: DataFrame, text: str = "line") -> DataFrame:
    """One row per identifier in a line: scan number, order inside the scan, raw text, kind, normal value, allow group.

    All shapes are read in one pass over the line and exploded once; nothing is shuffled.
    """
    def matches(scan: int, shape: str, kind: str, group: str) -> Column:
        def item(raw: Column, at: Column) -> Column:
            value = F.upper(F.regexp_replace(raw, r"[.\-]", "")) if kind == KIND_RG else digits_of(raw)
            return bind(
                value,
                lambda v: F.struct(
                    F.lit(scan).alias("scan"), at.alias("at"), raw.alias("raw"), v.alias("value"),
                    _kind(kind, v).alias("kind"), F.lit(group).alias("allow_group"),
                ),
            )

        return F.transform(F.regexp_extract_all(F.col(text), F.lit(shape), F.lit(0)), item)

    every = F.filter(F.flatten(F.array(*[matches(i, *scan) for i, scan in enumerate(_SCANS)])), lambda h: h["kind"].isNotNull())
    hits = lines.filter(F.col(text).rlike(ANY_DIGITS)).withColumn("_hit", F.explode_outer(every))
    return hits.filter("_hit IS NOT NULL").select("*", "_hit.*").drop("_hit")


def redact(value: Column, visible: int = 3) -> Column:
    hidden = F.greatest(F.length(value) - visible, F.lit(0))
    return F.concat(F.substring(value, 1, visible), F.repeat(F.lit("*"), hidden))


def allow_groups(allowed: DataFrame) -> DataFrame:
    """Allow-list rows (kind, value) under the group they are checked in: CPF and CNH values share one."""
    group = F.when(F.col("kind").isin(KIND_CPF, KIND_CNH), "CPF/CNH").otherwise(F.col("kind"))
    return allowed.select(group.alias("allow_group"), "value").distinct()


def scan_pii(lines: DataFrame, allowed: DataFrame | None = None, key: str = "path", line_no: str = "line_no", text: str = "line") -> DataFrame:
    """(key, line, kind, redacted) for every value with a right shape and check digits that is not allowed."""
    found = find_values(lines.select(key, line_no, text), text)
    if allowed is not None:
        found = found.join(hint_small(allow_groups(allowed)), ["allow_group", "value"], "left_anti")
    return found.select(key, line_no, "kind", redact(F.col("value")).alias("redacted"))


def scan_names(lines: DataFrame, names: DataFrame, key: str = "path", line_no: str = "line_no", text: str = "line", gram: int = 4) -> DataFrame:
    """Lines that contain a supplied name, accents and case ignored.

    A short list is looked up in each line as constants; of a longer one, all name prefixes are looked for in one pass
    over the line, and those found meet the names in an equality join.
    """
    listed = names.filter((F.trim("name") != "") & ~F.ltrim("name").startswith("#")).select(F.trim("name").alias("name"))
    listed = listed.withColumn("folded_name", fold_compat(F.col("name"))).distinct()
    folded = lines.select(key, line_no, fold_compat(F.col(text)).alias("folded_line"))
    rows = catalogue_rows(listed, NAME_CONSTANTS)
    if rows is not None:
        pairs = [F.struct(F.lit(r["name"]).alias("name"), F.lit(r["folded_name"]).alias("folded_name")) for r in rows]
        inside = bind(F.col("folded_line"), lambda line: F.filter(F.array(*pairs), lambda n: F.contains(line, n["folded_name"]))) if pairs else F.array().cast("array<struct<name:string,folded_name:string>>")
        hits = folded.select(key, line_no, F.explode_outer(inside).alias("n")).filter("n IS NOT NULL").select(key, line_no, F.col("n.name").alias("name"))
        return _named(hits, key, line_no)
    long = contains_join(folded, listed, "folded_line", "folded_name", gram)
    # Names shorter than a prefix meet the text on their whole length.
    short = listed.filter(F.length("folded_name") < gram).withColumn("_size", F.length("folded_name"))
    listed = piece_list(short, "folded_name")
    columns = [key, line_no, "name"]
    if listed == []:
        return _named(long.select(*columns), key, line_no)
    if listed is not None:
        parts = F.transform(pieces_in(F.col("folded_line"), listed), lambda p: p["piece"])
    else:
        parts = F.array_distinct(F.flatten(F.array(*[grams(F.col("folded_line"), n) for n in range(1, gram)])))
    offered = folded.withColumn("folded_name", F.explode_outer(parts)).filter(F.contains("folded_line", "folded_name"))
    brief = offered.join(hint_small(short.drop("_size")), "folded_name")
    return _named(long.select(*columns).unionByName(brief.select(*columns)), key, line_no)


def _named(found: DataFrame, key: str, line_no: str) -> DataFrame:
    redacted = F.concat(F.lit("contem '"), F.substring("name", 1, 2), F.lit("...'"))
    return found.select(key, line_no, F.lit(KIND_NAME).alias("kind"), redacted.alias("redacted"))


def pii_summary(findings: DataFrame, key: str = "path") -> DataFrame:
    return findings.groupBy(key, "kind").agg(F.count(F.lit(1)).alias("findings"))


# ---------------------------------------------------------------- masking


def mask_table(found: DataFrame, pools: Mapping[str, Sequence[str]], order: Sequence[str]) -> DataFrame:
    """(kind, value, replacement): the nth distinct value of a kind, by first appearance, takes the nth pool value.

    Distinct values are few next to their appearances and are reduced map-side first. They are
    numbered in two steps, by slices of the order, so a kind is never sorted in one task.
    """
    from cartorio.operators.ordering import ordered_positions

    first = found.groupBy("kind", "value").agg(F.min(F.struct(*order)).alias("seen"))
    slice_of = F.floor(F.col(f"seen.{order[0]}") / 100_000) if found.schema[order[0]].dataType.typeName() in ("long", "integer") else F.substring(f"seen.{order[0]}", 1, 4)
    ranked = ordered_positions(first, ["kind"], {"part": slice_of}, ["seen"], "nth")
    pool = F.create_map(*[x for kind, values in pools.items() for x in (F.lit(kind), F.array(*[F.lit(v) for v in sorted(values)]))])
    values = F.try_element_at(pool, F.col("kind"))
    return ranked.select("kind", "value", F.get(values, ((F.col("nth") - 1) % F.size(values)).cast("int")).alias("replacement"))


def format_like(raw: Column, plain: Column) -> Column:
    """``plain`` spelled with the punctuation of ``raw``: cut at its letters and digits, and put together with those of ``plain``."""
    sign = r"[\p{L}\p{N}]"
    gaps, own, new = F.split(raw, sign, -1), F.regexp_extract_all(raw, F.lit(sign), F.lit(0)), F.regexp_extract_all(plain, F.lit("(?s)."), F.lit(0))
    parts = F.transform(gaps, lambda gap, n: F.concat(gap, F.when(n < F.size(own), F.coalesce(F.get(new, n), F.get(own, n))).otherwise("")))
    return F.array_join(parts, "")


def mask_lines(lines: DataFrame, masks: DataFrame, allowed: DataFrame | None = None, keys: Sequence[str] = ("path", "line_no"), text: str = "line", found: DataFrame | None = None) -> DataFrame:
    """Lines with every finding replaced through the mask table, company numbers first, formatted before bare.

    A line is cut at the matches of all shapes, each match is looked up in the line's own map, and the parts are
    joined once: a replacement is never replaced again, and digits inside a longer number stay. Only lines with
    three digits in a row take part in the join, all others hold neither a finding nor a date and stay as they are. The mask
    table decides which kinds are replaced, voters' numbers among them. ``found`` are the findings in the lines
    (``find_values``), where these are known.
    """
    if found is None:
        found = find_values(lines.select(*keys, text), text)
    if allowed is not None:
        found = found.join(hint_small(allow_groups(allowed)), ["allow_group", "value"], "left_anti")
    swaps = (
        found.join(hint_small(masks), ["kind", "value"])
        .groupBy(*keys)
        .agg(F.map_from_entries(F.collect_set(F.struct("raw", format_like(F.col("raw"), F.col("replacement")).alias("new")))).alias("_swaps"))
    )
    numbered = F.coalesce(F.col(text).rlike(ANY_DIGITS), F.lit(False))
    joined = lines.filter(numbered).join(swaps, list(keys), "left")
    shapes = "|".join(shape for shape, _, _ in _SCANS)
    between, matched = F.split(F.col(text), shapes, -1), F.regexp_extract_all(F.col(text), F.lit(shapes), F.lit(0))
    parts = F.zip_with(between, matched, lambda gap, raw: F.concat(gap, F.coalesce(F.try_element_at("_swaps", raw), raw, F.lit(""))))
    masked = F.when(F.col("_swaps").isNull(), F.col(text)).otherwise(F.array_join(parts, ""))
    changed = joined.withColumn("masked", mask_dates(masked)).drop("_swaps")
    return changed.unionByName(lines.filter(~numbered).withColumn("masked", F.col(text)))


def mask_dates(text: Column) -> Column:
    """Day and month kept, the year moved to 2030..2049 by its remainder of twenty."""
    out = text
    for shape in (r"\b[0-9]{2}/[0-9]{2}/[0-9]{4}\b", rf"(?iu)\b(?:{MONTHS})/[0-9]{{4}}\b"):
        # The year is the last four characters of a match.
        out = replace_matches(out, shape, lambda m: F.concat(F.substring(m, F.lit(1), F.length(m) - 4), (F.lit(2030) + F.substring(m, -4, 4).try_cast("int") % 20).cast("int").cast("string")))
    return out


# How streets and cities are written.
ADDRESS_START = r"(?iu)^(?:R|RUA|AV|AVENIDA|PRA[CÇ]A|ALAMEDA|TRAVESSA|ROD|RODOVIA|ESTRADA)\.?\s+[A-ZÀ-Üa-zà-ü]"
CITY_STATE_CEP = r"(?iu)^([A-ZÀ-Ü][A-ZÀ-Ü '.]+?)\s*-\s*([A-Z]{2})\s*-?\s*CEP[:\s]*([0-9]{5}-[0-9]{3})$"


def mask_addresses(lines: DataFrame, key: str, line_no: str = "line_no", text: str = "masked") -> DataFrame:
    """Street lines and city lines replaced by numbered examples, counted per document in line order."""
    from cartorio.operators.ordering import ordered_positions

    bare = F.trim(text)
    city, street = bare.rlike(CITY_STATE_CEP), bare.rlike(ADDRESS_START)
    marked = lines.withColumn("_kind", first_case([(city, "CITY"), (street, "STREET")]))
    hits = ordered_positions(
        marked.filter(F.col("_kind").isNotNull()).select(key, line_no, "_kind", text), [key], {"part": F.floor(F.col(line_no) / 10_000)}, [line_no], "nth"
    )
    number = F.col("nth").cast("string")
    example = F.when(F.col("_kind") == "STREET", F.concat(F.lit("R EXEMPLO DA SILVA, "), number)).otherwise(
        F.concat(
            F.lit("CIDADE EXEMPLO "), number, F.lit(" - "), F.regexp_extract(F.trim(text), CITY_STATE_CEP, 2),
            F.lit(" - CEP "), F.regexp_extract(F.trim(text), CITY_STATE_CEP, 3),
        )
    )
    swapped = hits.select(key, line_no, example.alias("_example"))
    joined = lines.join(swapped, [key, line_no], "left")
    return joined.withColumn(text, F.coalesce(F.replace(F.col(text), F.trim(text), F.col("_example")), F.col(text))).drop("_example")


COMPANY_SUFFIX = r"(?iu)\b(?:LTDA|S\.?A\.?|ME|EIRELI|EPP|MEI)\b\.?\s*$"


def phrase_table(phrases: Sequence[str]) -> list[tuple[str, str]]:
    """(folded phrase, replacement) of ``REAL`` or ``REAL => SUBSTITUTE`` entries, longest first; lines with # are remarks.

    Entries are a short list kept by hand; without a substitute a numbered example of its kind stands in.
    """
    import re
    import unicodedata
    from itertools import count

    entry = re.compile(r"\s*(?!#|=>)(?P<real>\S.*?)\s*(?:=>\s*(?P<given>.*?)\s*)?", re.DOTALL)
    company = re.compile(COMPANY_SUFFIX)
    examples = {True: map("EMPRESA EXEMPLO {} LTDA".format, count(1)), False: map("TEXTO EXEMPLO {}".format, count(1))}
    known = [m.groupdict() for m in map(entry.fullmatch, phrases) if m]
    bare = lambda text: "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).upper()
    pairs = [(bare(e["real"]), next(examples[bool(company.search(e["real"]))]) if e["given"] is None else e["given"]) for e in known]
    return sorted(pairs, key=lambda pair: len(pair[0]), reverse=True)


def mask_phrases(text: Column, phrases: Sequence[tuple[str, str]]) -> Column:
    """Every phrase replaced wherever its folded spelling occurs, longest first."""
    import re

    from cartorio.functions.folding import fold_table

    source, target = fold_table("NFKD")
    variants: dict[str, str] = {}
    for char, base in zip(source, target):
        variants[base] = variants.get(base, "") + char
    out = text
    for plain, given in phrases:
        shape = "".join(f"[{re.escape(c)}{variants[c]}]\\p{{Mn}}*" if c in variants else re.escape(c) for c in plain)
        out = F.regexp_replace(out, shape, given.replace("\\", "\\\\").replace("$", "\\$"))
    return out


def residual_check(masked: DataFrame, allowed: DataFrame, key: str = "path", line_no: str = "line_no", text: str = "masked") -> DataFrame:
    """Findings that are still in masked text; an empty result is the pass."""
    return scan_pii(masked, allowed, key, line_no, text)
