"""Lead lists, dashboards, latest runs, detail rows and exports."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadloom.functions import text

WITHHELD = "[DO_NOT_CONTACT]"


def latest(rows: DataFrame, keys: list[str], order: list[Column], k: int = 1) -> DataFrame:
    """The k latest rows of every key, numbered in n; the filter becomes a group limit on both sides of the shuffle."""
    return rows.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("n") <= k)


def latest_runs(scores: DataFrame, k: int = 1) -> DataFrame:
    """The k latest scoring runs of every lead; equal times go to the larger score_no; repeated rows count once.

    NaN figures become null in every column of floating point.
    """
    once = scores.dropDuplicates(["score_no", "lead_id"])
    once = once.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c, t in once.dtypes if t in ("double", "float")})
    return latest(once, ["lead_id"], [F.desc_nulls_last("scored_at"), F.desc_nulls_last("score_no")], k)


def current(leads: DataFrame, scores: DataFrame) -> DataFrame:
    """Leads with the figures of their latest run; leads without runs have nulls. NaN figures count as missing."""
    fields = ["sales_opportunity", "website_health", "contact_confidence", "audit_confidence"]
    s = latest_runs(scores).select("lead_id", *fields, F.col("priority").alias("run_priority"))
    return leads.join(s, "lead_id", "left")


def dashboard(leads: DataFrame, contacts: DataFrame) -> DataFrame:
    """One row of counts and means over current leads and contacts; means are null when there is nothing to average."""
    a = leads.agg(
        F.count("*").alias("businesses"), F.count_if(F.col("website").isNotNull()).alias("with_website"), F.count_if(F.col("run_priority") == "HOT").alias("hot"),
        F.count_if(F.col("run_priority") == "WARM").alias("warm"), F.round(F.avg("website_health"), 6).alias("mean_health"), F.round(F.avg("sales_opportunity"), 6).alias("mean_opportunity"),
    )
    c = contacts.agg(F.count_if(F.coalesce(F.col("primary_contact"), F.lit(False)) & F.col("verification_status").isin("CONFIRMED", "LIKELY")).alias("verified_contacts"))
    return a.crossJoin(c)  # two single rows


SORTS = {"opportunity": "sales_opportunity", "health": "website_health"}


def lead_filter(leads: DataFrame, category: str | None = None, priority: str | None = None, grade: str | None = None, city: str | None = None,
                search: str | None = None, floors: dict[str, float] | None = None) -> DataFrame:
    """All given conditions hold: equal category, priority, grade; city and search by pattern without case; a missing figure passes no floor.

    A search looks into the canonical name, where the leads have one, the name and the category. A text that is no
    valid pattern is an error before any job starts.
    """
    for v in (city, search):
        if v is not None:
            try:
                re.compile(v)
            except re.error as e:
                raise ValueError(f"not a search pattern: {v!r}") from e
    out = leads
    for c, v in (("category", category), ("run_priority", priority), ("data_quality_grade", grade)):
        if v is not None:
            out = out.filter(F.col(c) == v)
    if city is not None:
        out = out.filter(F.col("city").rlike(f"(?i){city}"))
    if search is not None:
        hit = lambda c: F.coalesce(F.col(c).rlike(f"(?i){search}"), F.lit(False))
        out = out.filter(reduce(lambda a, b: a | b, [hit(c) for c in ("canonical_name", "business_name", "category") if c in leads.columns]))
    for c, v in (floors or {}).items():
        out = out.filter(F.col(c) >= v)
    return out


def lead_page(leads: DataFrame, sort: str = "opportunity", page: int = 1, size: int = 25) -> DataFrame:
    """One page of a sorted list; missing figures last, names ascending with missing first, ties by record_no."""
    order = F.asc_nulls_first("business_name") if sort == "name" else F.desc_nulls_last(SORTS[sort])
    return leads.orderBy(order, "record_no").offset((page - 1) * size).limit(size)


def page_counts(leads: DataFrame, size: int = 25) -> DataFrame:
    return leads.agg(F.count("*").alias("total")).withColumn("pages", F.ceil(F.col("total") / size))


def display_contacts(contacts: DataFrame) -> DataFrame:
    """(lead_id, phone, email, whatsapp, contacts, names): the contact to show of each kind, primary first, then confidence.

    Missing, NaN and out-of-range confidences come last; ties go to the smaller row_no.
    """
    conf = F.when(F.col("confidence").between(0, 1) & ~F.isnan("confidence"), F.col("confidence"))
    order = F.struct(F.when(F.col("primary_contact"), 0).otherwise(1), F.coalesce(-conf, F.lit(1.0)), "row_no")
    best = lambda kind: F.min_by(F.when(F.col("contact_type") == kind, F.col("contact_value")), F.when(F.col("contact_type") == kind, order))
    return contacts.groupBy("lead_id").agg(
        best("PHONE").alias("phone"), best("EMAIL").alias("email"), best("WHATSAPP").alias("whatsapp"), F.countDistinct("row_no").alias("contacts"),
    )


def withheld(flag: Column, c: Column) -> Column:
    """A fixed marker instead of the value where contact isn't wanted."""
    return F.when(flag & c.isNotNull(), WITHHELD).otherwise(c)


def export_rows(leads: DataFrame, contacts: DataFrame, opted_out: Column | None = None) -> DataFrame:
    """One safe row a lead record: figures, display contacts, address line; unsorted (export.sheet sorts).

    opted_out is a condition on lead columns; phone and mail are then withheld, the chat number is not.
    """
    flag = opted_out if opted_out is not None else F.lit(False)
    j = leads.join(display_contacts(contacts), "lead_id", "left").withColumn("out", flag)
    cells = {
        "business_name": F.col("business_name"), "category": F.col("category"), "city": F.col("city"), "address_line": F.nullif(text.joined(", ", F.col("address"), F.col("locality"), F.col("city")), F.lit("")),
        "website": F.col("website"), "phone": withheld(F.col("out"), F.col("phone")), "email": withheld(F.col("out"), F.col("email")), "whatsapp": F.col("whatsapp"),
    }
    return j.select("record_no", "lead_id", F.col("run_priority").alias("priority"), *[text.safe_cell(v).alias(k) for k, v in cells.items()],
                    "sales_opportunity", "website_health", "audit_confidence", F.coalesce("contacts", F.lit(0)).alias("contacts"))


def export_styles(exported: DataFrame) -> DataFrame:
    """Labels of the cells that a workbook would colour."""
    band = lambda c: F.when(F.col(c) >= 80, "good").when(F.col(c) >= 60, "fair").when(F.col(c) >= 40, "weak").when(F.col(c).isNotNull(), "poor")
    mark = lambda cond, name: F.when(F.coalesce(cond, F.lit(False)), name)
    return exported.select(
        "record_no", mark(F.col("priority") == "HOT", "hot").alias("priority_style"), mark(F.col("website").isNull() | (F.col("website") == ""), "missing").alias("website_style"),
        mark(F.col("phone").isNull() & F.col("email").isNull() & F.col("whatsapp").isNull(), "missing").alias("contact_style"),
        mark(F.coalesce("audit_confidence", F.lit(100.0)) < 50, "low").alias("confidence_style"), band("sales_opportunity").alias("opportunity_style"), band("website_health").alias("health_style"),
    )


def write_sheets(sheets: dict[str, DataFrame], folder: str, kind: str = "parquet") -> None:
    """Every sheet into its own folder, as parquet or as CSV with a header; existing sheets are replaced."""
    for name, df in sheets.items():
        w = df.write.mode("overwrite")
        w.option("header", True).csv(f"{folder}/{name}") if kind == "csv" else w.parquet(f"{folder}/{name}")


def run_metadata(name: str, df: DataFrame) -> DataFrame:
    """(name, row_count, status) of an export: FAILED where nothing was there to export."""
    return df.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("name"), "row_count", F.when(F.col("row_count") > 0, "COMPLETED").otherwise("FAILED").alias("status"))


def allowed_columns(df: DataFrame, policy: list[str]) -> DataFrame:
    """Only the columns that a policy names; '*' allows all."""
    return df if "*" in policy else df.select(*[c for c in df.columns if c in policy])


def export_filter(leads: DataFrame, job: str | None = None, priority: str | None = None, category: str | None = None, grade: str | None = None, floor: float | None = None) -> DataFrame:
    """Rows for an export: membership of a job in the row's array of jobs, equal priority, category and grade, least opportunity."""
    out = lead_filter(leads, category=category, priority=priority, grade=grade, floors=None if floor is None else {"sales_opportunity": floor})
    return out if job is None else out.filter(F.array_contains("jobs", job))
