"""Published growth rates from report text.

Input is a table of text lines: `source_file`, `line_no` (1, 2, ..), `text`.
`tag_lines` reads the text once: it says what each line is and takes its fields
apart. The readers then work on tags. Section state is a chunked carry over line
numbers, so one long file is spread over tasks. Only the head of a file, which is
where the template says its name, is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acreline.functions import codes
from acreline.functions.cleaning import parse_money
from acreline.operators.running import running
from acreline.operators.sets import stack
from acreline.operators.windows import first_row

FILE, LINE, TEXT = "source_file", "line_no", "text"
LINES_PER_CHUNK = 10_000
HEAD_LINES, SPECIALTY_HEAD_LINES = 200, 120
_SEP = "\u0001"
_ROWS = {"res": (codes.RES_RATE_ROW, 6), "com": (codes.DISTRICT_ROW, 5),
         "total": (codes.SPECIALTY_TOTAL, 4), "sub": (codes.SPECIALTY_ROW, 4)}


def tag_lines(lines: DataFrame) -> DataFrame:
    """Row kind and fields, table marker, specialty header and head text per line.

    A row shape begins with "Area", a number and an amount, an amount, or two
    numbers, so a line has one kind. The marker is 1 at a district header, NULL at
    rows and blank lines, and 0 at any other text.
    """
    text = F.col(TEXT)

    def fields(pattern, n):
        joined = F.regexp_replace(text, pattern + ".*$", _SEP.join(f"${i}" for i in range(1, n + 1)))
        return F.split(joined, _SEP)

    kind = parts = None
    for name, (pattern, n) in _ROWS.items():
        # Every row shape holds a percent sign: most text is settled without a pattern.
        hit = text.contains("%") & text.rlike(pattern)
        kind = F.when(hit, name) if kind is None else kind.when(hit, name)
        mine = F.col("kind") == name
        parts = (F.when(mine, fields(pattern, n)) if parts is None
                 else parts.when(mine, fields(pattern, n)))
    marker = (F.when(text.contains("Total Value") & text.rlike(codes.DISTRICT_HEADER), 1)
              .when((F.col("kind") == "com") | text.rlike(r"^\s*$"), F.lit(None).cast("int"))
              .otherwise(0))
    return lines.withColumn("kind", kind).select(
        FILE, LINE, "kind", parts.alias("f"), marker.alias("marker"),
        text.rlike(codes.SPECIALTY_HEADER).alias("spec_header"),
        F.when(F.col(LINE) <= HEAD_LINES, text).alias("head"))


def _field(n: int) -> Column:
    return F.element_at("f", n)


def _money(n: int) -> Column:
    return parse_money(_field(n))


def _rates(df: DataFrame, prop_type: str, kind: str, **cols: Column) -> DataFrame:
    null_int, null_num = F.lit(None).cast("int"), F.lit(None).cast("double")
    return df.select(
        F.col(FILE), F.col(LINE),
        F.lit(prop_type).alias("prop_type"), F.lit(kind).alias("report_kind"),
        cols.get("area", null_int).cast("int").alias("area"),
        cols.get("spec_area", null_int).cast("int").alias("spec_area"),
        cols.get("spec_sub", null_int).cast("int").alias("spec_sub"),
        cols.get("basis", F.lit("population")).alias("basis"),
        cols.get("av_prev", null_num).alias("av_prev"),
        cols["av_curr"].alias("av_curr"),
        cols.get("delta", null_num).alias("delta"),
        (cols["pct"] / 100).alias("pct_change"))


def _res_rates(tagged: DataFrame) -> DataFrame:
    basis = F.when(_field(2) == "Pop", F.lit("population")).otherwise(F.lit("sales"))
    return _rates(tagged.filter("kind = 'res'"), "res", "geo", area=_field(1), basis=basis,
                  av_prev=_money(3), av_curr=_money(4), delta=_money(5), pct=_money(6))


def _com_rates(tagged: DataFrame) -> DataFrame:
    # A row belongs to a table when the last marker before it is a header.
    state = running(tagged.select(FILE, LINE, "kind", "f", "marker"), [FILE], LINE,
                    {"_table": ("last", "marker")},
                    chunk=F.floor(F.col(LINE) / LINES_PER_CHUNK))
    rows = state.filter((F.col("kind") == "com") & F.col("marker").isNull()
                        & (F.col("_table") == 1))
    return _rates(rows, "com", "geo", area=_field(1), av_prev=_money(2), av_curr=_money(3),
                  delta=_money(4), pct=_money(5))


def _head_text(tagged: DataFrame, n: int) -> DataFrame:
    """First n lines of each file joined by spaces."""
    head = tagged.filter(F.col(LINE) <= n).groupBy(FILE).agg(
        F.array_sort(F.collect_list(F.struct(LINE, "head"))).alias("_head"))
    return head.select(FILE, F.array_join(
        F.transform("_head", lambda s: s["head"]), " ").alias("head"))


def _spec_rates(tagged: DataFrame) -> DataFrame:
    found = F.regexp_extract("head", codes.SPECIALTY_NUMBER, 1).try_cast("int")
    in_name = F.regexp_extract(FILE, r"(\d{2,3})", 1).try_cast("int")
    specs = (_head_text(tagged, SPECIALTY_HEAD_LINES)
             .select(FILE, F.coalesce(found, in_name).alias("spec_no"))
             .filter(F.col("spec_no").isNotNull()))

    # A total counts within six lines of a header: give each header its six lines.
    near = tagged.filter("spec_header").select(
        FILE, F.col(LINE).alias("header"),
        F.explode(F.sequence(F.col(LINE) + 1, F.col(LINE) + 6)).alias(LINE))
    totals = tagged.filter("kind = 'total'").select(FILE, LINE, "f").join(near, [FILE, LINE])
    totals = first_row(totals, FILE, ["header", LINE]).join(specs, FILE)
    total_rows = _rates(totals, "com", "specialty", spec_area=F.col("spec_no"),
                        av_prev=_money(1), av_curr=_money(2), delta=_money(3), pct=_money(4))

    subs = (tagged.filter("kind = 'sub'").select(FILE, LINE, "f").join(specs, FILE)
            .filter(_field(1).cast("int") == F.col("spec_no"))
            .withColumn("_sub", _field(2).cast("int")))
    subs = first_row(subs, [FILE, "_sub"], LINE)
    sub_rows = _rates(subs, "com", "specialty_submarket", spec_area=F.col("spec_no"),
                      spec_sub=F.col("_sub"), av_curr=_money(3), pct=_money(4))
    return total_rows.unionByName(sub_rows)


def extract_res_rates(lines: DataFrame) -> DataFrame:
    """Rows "Area n Sales|Pop previous current change %"."""
    return _res_rates(tag_lines(lines))


def extract_com_rates(lines: DataFrame) -> DataFrame:
    """Rows below a district header, up to a total or any other text line."""
    return _com_rates(tag_lines(lines))


def extract_spec_rates(lines: DataFrame, checkpoint: bool = True) -> DataFrame:
    """Specialty number, its first total near a header, and submarket rows once.

    Four branches read the tags, so they are checkpointed: the text is read once.
    """
    tagged = tag_lines(lines)
    return _spec_rates(tagged.checkpoint() if checkpoint else tagged)


def templates(lines: DataFrame, tagged: DataFrame | None = None) -> DataFrame:
    """Template and title per file, from its first 200 lines."""
    head = F.col("head")
    kind = (F.when(head.rlike("(?i)Specialty")
                   & ~head.rlike("(?i)Geographic Areas Report"), "spec")
            .when(head.rlike("(?i)Residential Revalue"), "res")
            .when(head.rlike("(?i)Commercial Revalue"), "com")
            .otherwise("unknown"))
    title = (lines.filter(F.length(F.trim(TEXT)) > 0).groupBy(FILE)
             .agg(F.trim(F.min_by(TEXT, LINE)).alias("district")))
    heads = _head_text(tag_lines(lines) if tagged is None else tagged, HEAD_LINES)
    return heads.select(FILE, kind.alias("template")).join(title, FILE, "left")


def extract_rates(lines: DataFrame, assessment_yr: int, checkpoint: bool = True) -> DataFrame:
    """Rates of all files; an unknown template takes the first reader that finds rows.

    The tags feed three readers, so they are checkpointed: the text is read once.
    """
    tagged = tag_lines(lines)
    if checkpoint:
        tagged = tagged.checkpoint()
    readers = {"res": _res_rates, "com": _com_rates, "spec": _spec_rates}
    found = stack([read(tagged).withColumns({"_reader": F.lit(name), "_try": F.lit(i)})
                   for i, (name, read) in enumerate(readers.items())])
    kinds = templates(lines, tagged)
    first_try = found.groupBy(FILE).agg(F.min("_try").alias("_first_try"))
    kept = (found.join(kinds, FILE).join(first_try, FILE)
            .filter((F.col("_reader") == F.col("template"))
                    | ((F.col("template") == "unknown") & (F.col("_try") == F.col("_first_try")))))
    return kept.select(
        F.lit(assessment_yr).alias("assessment_yr"), "prop_type", "report_kind", "area",
        "spec_area", "spec_sub", "basis", "av_prev", "av_curr", "delta", "pct_change",
        F.try_divide("delta", "av_prev").alias("pct_change_chk"), "district", FILE)
