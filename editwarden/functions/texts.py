"""Expressions on labels, comments, numbers as text and XML text."""

from pyspark.sql import Column
from pyspark.sql import functions as F

REVERT_WORDS = "(?i)vandalism|revert"
CHANGESET_NUMBER = r"\b(\d{6,})\b"
ELEMENTS = ("node", "way", "relation")
ACTIONS = ("create", "modify", "delete")


def yes_no(value: Column) -> Column:
    """``yes`` or ``no`` for the spellings in use, else null."""
    text = value.cast("string")
    return F.when(text.isin("yes", "TRUE", "true"), "yes").when(text.isin("no", "FALSE", "false"), "no")


def checked_label(value: Column) -> Column:
    """0 or 1 from a boolean or a 0/1 number; anything else stops the job."""
    number = value.cast("double")
    message = F.concat(F.lit("not a 0/1 label: "), F.coalesce(value.cast("string"), F.lit("null")))
    return F.when(number.isin(0.0, 1.0), number.cast("int")).otherwise(F.raise_error(message).cast("int"))


def decimal_comma(text: Column) -> Column:
    return F.regexp_replace(text, ",", ".").cast("double")


def percentage_text(part: Column, whole: Column) -> Column:
    """Percentage with four decimals as text; 0.0000 when there is nothing to divide by."""
    share = F.coalesce(F.try_divide(part * F.lit(100.0), whole.cast("double")), F.lit(0.0))
    return F.format_string("%.4f", share)


def tells_of_revert(comment: Column) -> Column:
    return F.coalesce(comment.rlike(REVERT_WORDS), F.lit(False))


def reverted_changeset(comment: Column) -> Column:
    """First number of six or more digits in a comment."""
    found = F.regexp_extract(comment, CHANGESET_NUMBER, 1)
    return F.when(found != "", found)


def osmchange_counts(xml: Column) -> dict[str, Column]:
    """Elements and actions counted in an osmChange document; 0 when there is none. Parsed once."""
    children = ", ".join(f"{e}: ARRAY<STRUCT<_id: STRING>>" for e in ELEMENTS)
    document = F.from_xml(xml, ", ".join(f"{a} ARRAY<STRUCT<{children}>>" for a in ACTIONS))

    def count(action: str, element: str) -> Column:
        blocks = F.coalesce(document[action], F.array())
        return F.aggregate(blocks, F.lit(0), lambda n, block: n + F.coalesce(F.size(block[element]), F.lit(0)))

    def total(pairs) -> Column:
        return sum((count(a, e) for a, e in pairs), F.lit(0))

    counts = {f"no_{e}s": total((a, e) for a in ACTIONS) for e in ELEMENTS}
    names = {"create": "no_creates", "modify": "no_modifications", "delete": "no_deletions"}
    return counts | {names[a]: total((a, e) for e in ELEMENTS) for a in ACTIONS}


def user_info(xml: Column) -> dict[str, Column]:
    """Account creation time and number of changesets from a user document."""
    created = F.xpath_string(xml, F.lit("/osm/user/@account_created"))
    return {
        "account_created": F.when(created != "", created).try_cast("timestamp_ntz"),
        "changes_count": F.coalesce(F.xpath_int(xml, F.lit("/osm/user/changesets/@count")), F.lit(0)),
    }
