"""HL7 v2 text as Column expressions; all native."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The characters that are blank at the edges of a line.
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0                　"


def computed_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` with ``columns``, each evaluated once a row however often it is used.

    Catalyst copies expressions into every filter and join condition that mentions them; it can't through a generator.
    """
    made = F.array(F.struct(*[c.alias(f"__new_{n}") for n, c in columns.items()]))
    return df.select("*", F.inline(made)).drop(*columns).withColumnsRenamed({f"__new_{n}": n for n in columns})


def bound(value: Column, made) -> Column:
    """``made`` of ``value``, which is evaluated once however often it is used in there."""
    return F.get(F.transform(F.array(value), made), F.lit(0))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def decoded(raw: Column) -> Column:
    """Text of raw bytes; what isn't UTF-8 becomes U+FFFD."""
    return F.make_valid_utf8(raw.cast("string"))


def _with_returns(text: Column) -> Column:
    """LF as CR; most texts hold no LF, which a look for it tells sooner than the replacement."""
    return F.when(F.contains(text, F.lit("\n")), F.replace(text, F.lit("\n"), F.lit("\r"))).otherwise(text)


def lines(text: Column) -> Column:
    """Physical lines; CR, LF or both end one, and an empty line may stand between the two of a pair."""
    return F.split(_with_returns(text), "\r")


def segments(text: Column) -> Column:
    """array<struct<type, fields>>: the stripped lines that aren't blank, split at "|"."""

    def stripped(line: Column) -> Column:
        """Most lines have nothing to strip, which their first and last signs tell sooner."""
        seen = lambda c: F.ascii(c).between(33, 126)
        return F.when(seen(line) & seen(F.right(line, F.lit(1))), line).otherwise(strip(line))

    said = F.filter(F.transform(lines(F.coalesce(text, F.lit(""))), stripped), lambda line: line != "")
    return F.transform(F.transform(said, lambda line: F.split(line, r"\|")), lambda fields: F.struct(fields[0].alias("type"), fields.alias("fields")))


#: The blanks that end no line, as a class of a regular expression.
_INNER = "[" + "".join(f"\\u{ord(c):04x}" for c in BLANKS if c not in "\r\n") + "]"


def joined(text: Column) -> Column:
    """The lines, with a CR before the first and after each one."""
    return F.concat(F.lit("\r"), _with_returns(F.coalesce(text, F.lit(""))), F.lit("\r"))


def loose(whole: Column) -> Column:
    """Of a ``joined`` text: whether a line, field, repetition or component has a blank at its edge, so that there is something to strip.

    Most texts hold visible ASCII alone, which is told sooner.
    """
    return ~whole.rlike(r"\A[!-~\r]*\z") & whole.rlike(rf"{_INNER}[|^~\r]|[|^~\r]{_INNER}")


def tidy(value: Column, is_loose: Column) -> Column:
    """``strip`` of a part of a message; ``is_loose``: whether the message has anything to strip."""
    return F.when(is_loose, strip(value)).otherwise(value)


def fields_of(whole: Column, is_loose: Column, kind: str) -> Column:
    """The fields of the first segment of a kind, as ``segments`` has them, without the others; the first is empty where there is none."""
    line = F.regexp_extract(whole, rf"\r{_INNER}*({kind}(?:\|[^\r]*|{_INNER}*))\r", 1)
    return F.when(is_loose, F.split(strip(line), r"\|")).otherwise(F.split(_plain_line(whole, kind), r"\|"))


def _plain_line(whole: Column, kind: str) -> Column:
    """The first line of a ``joined`` text that begins with a kind of segment as it stands, "" if there is none.

    The pattern begins with plain text, for which Java looks in strides.
    """
    return F.substring(F.regexp_extract(whole, rf"\r{kind}(?:\|[^\r]*)?(?=\r)", 0), 2, 2**31 - 1)


def field(fields: Column, n: int) -> Column:
    """Field n, "" where it is missing.  In MSH, index n is MSH-(n+1)."""
    return F.coalesce(F.get(fields, F.lit(n)), F.lit(""))


def first_segment(segs: Column, kind: str) -> Column:
    return F.get(F.filter(segs, lambda s: s["type"] == kind), F.lit(0))


def component(value: Column, n: int) -> Column:
    """Component n from 1, "" where it is missing."""
    return F.coalesce(F.get(F.split(value, r"\^"), F.lit(n - 1)), F.lit(""))


def message_type(segs: Column) -> Column:
    """MSH-9 of the first MSH, else UNKNOWN."""
    return F.coalesce(F.get(first_segment(segs, "MSH")["fields"], F.lit(8)), F.lit("UNKNOWN"))


def control_id(segs: Column) -> Column:
    return F.coalesce(F.get(first_segment(segs, "MSH")["fields"], F.lit(9)), F.lit("UNKNOWN"))


def marker(text: Column, is_loose: Column | None = None) -> Column:
    """struct<msh3, msh4, msh10> of the first physical line, whatever its type; null where empty.

    ``is_loose``: whether the message has anything to strip, if that is known.
    """
    return marker_of(first_line(text), is_loose)


def first_line(text: Column) -> Column:
    """The fields of the first physical line, whatever its type."""
    return F.split(F.regexp_extract(F.coalesce(text, F.lit("")), r"\A[^\r\n]*", 0), r"\|")


def marker_of(fields: Column, is_loose: Column | None = None) -> Column:
    """``marker`` of the fields of ``first_line``."""
    own = lambda value: strip(value) if is_loose is None else tidy(value, is_loose)
    part = lambda n: F.nullif(own(F.coalesce(F.get(fields, F.lit(n)), F.lit(""))), F.lit(""))
    return F.struct(part(2).alias("msh3"), part(3).alias("msh4"), part(9).alias("msh10"))


def tenant(text: Column) -> Column:
    """MSH-3|MSH-4, "" when both are empty."""
    m = marker(text)
    app, place = F.coalesce(m["msh3"], F.lit("")), F.coalesce(m["msh4"], F.lit(""))
    return F.when((app == "") & (place == ""), F.lit("")).otherwise(F.concat_ws("|", app, place))


def timestamp(value: Column) -> Column:
    """A point in time (UTC, whole seconds) from the leading digits of an HL7 time; null if it isn't one.

    Eight digits at least; hour, minute and second count when both their digits are there; a zone is ignored.
    """
    whole = value.rlike(_WHOLE_TIME)  # most times; read without a lambda, which Spark interprets
    return F.when(whole, _whole_time(value)).otherwise(bound(_digits(value), _time_of))


_WHOLE_TIME = r"^(?!0000)[0-9]{14}$"


def _digits(value: Column) -> Column:
    return F.regexp_extract(F.coalesce(value, F.lit("")), r"^\s*(\d+)", 1)


def _whole_time(value: Column) -> Column:
    part = lambda at, size: F.substring(value, at, size)
    return F.concat(part(1, 4), F.lit("-"), part(5, 2), F.lit("-"), part(7, 2), F.lit(" "), part(9, 2), F.lit(":"), part(11, 2), F.lit(":"), part(13, 2)).try_cast("timestamp")


def _time_of(digits: Column) -> Column:
    n = F.length(digits)
    part = lambda at, size, least: F.when(n >= least, F.substring(digits, at, size).cast("int")).otherwise(F.lit(0))
    year = F.when(n >= 8, F.substring(digits, 1, 4).cast("int"))
    second = part(13, 2, 14)
    return F.when((year >= 1) & (second < 60), F.try_make_timestamp(year, part(5, 2, 8), part(7, 2, 8), part(9, 2, 10), part(11, 2, 12), second))


def with_timestamps(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` with ``timestamp`` of each of ``columns``, read step by step, without lambdas."""
    rows = computed_once(df, {f"__of_{n}": F.when(c.rlike(_WHOLE_TIME), c).otherwise(_digits(c)) for n, c in columns.items()})
    read = lambda c: F.when(c.rlike(_WHOLE_TIME), _whole_time(c)).otherwise(_time_of(c))
    return computed_once(rows, {n: read(F.col(f"__of_{n}")) for n in columns}).drop(*[f"__of_{n}" for n in columns])


def degraded_text(coded: Column) -> Column:
    """The text of a coded field that has neither identifier nor system; else null."""
    code, text, system = (strip(component(coded, n)) for n in (1, 2, 3))
    return F.when((F.left(strip(coded), F.lit(1)) == "^") & (text != "") & (code == "") & (system == ""), text)


@dataclass(frozen=True)
class KeyConfig:
    """Where a site's messages name the patient; fields and components are counted from 1."""

    segment: str = "PID"
    field: int = 3
    id_part: int = 1
    authority_part: int = 4
    type_part: int = 5
    wanted: str = "MR"
    authority: str = ""  #: stands in for a missing one


def _named(text: Column, config: KeyConfig) -> Column:
    """The configured field of each such line; lines are read as they stand, without stripping."""
    own = F.filter(lines(F.coalesce(text, F.lit(""))), lambda line: (line == config.segment) | F.startswith(line, F.lit(f"{config.segment}|")))
    return F.transform(own, lambda line: field(F.split(line, r"\|"), config.field))


def patient_keys(text: Column, wanted: str = "MR", authority: str = "", config: KeyConfig | None = None) -> Column:
    """Sorted distinct ``authority|id`` of the repetitions of the wanted type; empty if there is none.

    Without ``config``, PID-3 is read.  A repetition without an id, or without an authority where none stands in, gives none:
    an id alone is unique in its own house only.
    """
    c = config or KeyConfig(wanted=wanted, authority=authority)

    def key(rep: Column) -> Column:
        def made(own):
            def named(parts: Column) -> Column:
                who, place, kind = (own(F.coalesce(F.get(parts, F.lit(n - 1)), F.lit(""))) for n in (c.id_part, c.authority_part, c.type_part))
                place = F.when(place != "", place).otherwise(F.lit(c.authority))
                return F.when((kind == c.wanted) & (who != "") & (place != ""), F.concat_ws("|", place, who))

            return bound(F.split(rep, r"\^"), named)

        return F.when(rep.rlike("[^!-~]"), made(strip)).otherwise(made(lambda part: part))

    begin = f"\r{c.segment}"

    def listed(whole: Column) -> Column:
        """Most texts have one such line, with one repetition, which needs no list of lines."""
        lone = F.length(whole) - F.length(F.replace(whole, F.lit(begin), F.lit(""))) == len(begin)
        only = F.when(lone, field(F.split(_plain_line(whole, c.segment), r"\|"), c.field))
        several = F.flatten(F.transform(_named(text, c), lambda x: F.split(x, "~")))
        all_of_them = F.array_sort(F.array_distinct(F.array_compact(F.transform(several, key))))
        return bound(only, lambda rep: F.when(F.instr(rep, "~") == 0, F.array_compact(F.array(key(rep)))).otherwise(all_of_them))

    return bound(joined(text), listed)


def with_patient_keys(df: DataFrame, name: str, text: str = "text", wanted: str = "MR", authority: str = "", config: KeyConfig | None = None, status: str | None = None) -> DataFrame:
    """``df`` with column ``name``: ``patient_keys`` of column ``text``; with ``status``, also their ``patient_class``, and without the text.

    The key of a text with one such line and one repetition of visible ASCII is read step by step, without lambdas, which Spark
    interprets.
    """
    c = config or KeyConfig(wanted=wanted, authority=authority)
    begin = f"\r{c.segment}"
    rows = computed_once(df, {"__text": joined(F.col(text))})
    lone = F.contains("__text", F.lit(begin)) & ~F.col("__text").rlike(rf"(?s)\r{c.segment}.*\r{c.segment}")
    rows = computed_once(rows, {"__rep": F.when(lone, field(F.split(_plain_line(F.col("__text"), c.segment), r"\|"), c.field))}).drop("__text")
    rows = computed_once(rows, {"__rep": F.when(~F.col("__rep").rlike("[^!-}]"), F.split("__rep", r"\^"))})  # "~" parts repetitions
    who, place, kind = (field(F.col("__rep"), n - 1) for n in (c.id_part, c.authority_part, c.type_part))
    place = F.when(place != "", place).otherwise(F.lit(c.authority))
    one = F.when((kind == c.wanted) & (who != "") & (place != ""), F.array(F.concat_ws("|", place, who))).otherwise(F.array().cast("array<string>"))
    rows = computed_once(rows, {"__one": F.when(F.col("__rep").isNotNull(), one)}).drop("__rep")
    keys = F.when(F.col("__one").isNotNull(), F.col("__one"))
    if status is None:
        return computed_once(rows, {name: keys.otherwise(patient_keys(F.col(text), config=c))}).drop("__one")
    # texts that are read no further don't go along
    rows = computed_once(rows, {"__odd": F.when(F.coalesce(F.size("__one") <= 0, F.lit(True)), F.col(text))}).drop(text)
    rows = computed_once(rows, {name: keys.otherwise(patient_keys(F.col("__odd"), config=c))})
    return rows.withColumn(status, patient_class(F.col("__odd"), F.col(name), c)).drop("__one", "__odd")


def patient_class(text: Column, keys: Column, config: KeyConfig = KeyConfig()) -> Column:
    """keyed, unresolved (an identifier without a key) or patientless."""
    named = F.exists(_named(text, config), lambda x: strip(x) != "")
    return F.when(F.size(keys) > 0, F.lit("keyed")).when(named, F.lit("unresolved")).otherwise(F.lit("patientless"))
