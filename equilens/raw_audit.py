"""From the raw decision file to the tables of the audit, as one job.

raw file -> good rows and a quarantine of bad lines -> target recoded, group and age band derived
(the analysis table) -> text columns as codes (the numeric table), with the code table saved, so that
later rows are coded alike (Q6). Everything lies under ``out``: ``quarantine``, ``analysis``,
``numeric``, ``encoder``.

    python -m equilens.raw_audit --raw /shared/decisions.data --out /shared/audit

An empty file gives empty tables. A target or status code that the maps don't hold becomes null; the
group of a null status is null; an age outside the bands has a null band. The numeric table keeps the
band's label, as the audited pipeline does.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .functions.exprs import right_closed_bins
from .operators.encode import CategoryEncoder, derive_group, dictionary_frame, recode_target
from .sources import store
from .spec import AGE_BIN_EDGES, AGE_BIN_LABELS

# --- fixed values: target and status codes of the raw file -----------------
TARGET_CODES = {1: 0, 2: 1}
STATUS_GROUPS = (("A91", "male"), ("A92", "female"), ("A93", "male"), ("A94", "male"), ("A95", "female"))
PRIVILEGED_GROUP = "male"
# ---------------------------------------------------------------------------


def analysis_table(raw: DataFrame) -> DataFrame:
    """The raw columns with the recoded target, ``gender`` (text) and ``age_group``."""
    df = recode_target(raw, "credit_risk", TARGET_CODES, out="credit_risk")
    groups = dictionary_frame(raw.sparkSession, STATUS_GROUPS, ["code", "gender"])
    df = derive_group(df, "personal_status_sex", groups, PRIVILEGED_GROUP, "gender", "_g").drop("_g")
    return df.withColumn("age_group", right_closed_bins("age", AGE_BIN_EDGES, AGE_BIN_LABELS))


def coded_columns(analysis: DataFrame) -> list[str]:
    """Text columns but for the derived ones."""
    return [f.name for f in analysis.schema.fields if isinstance(f.dataType, StringType) and f.name not in ("gender", "age_group")]


def numeric_table(analysis: DataFrame, encoder: CategoryEncoder) -> DataFrame:
    """Codes in place of text, gender as 0 / 1."""
    gender = F.when(F.col("gender").isNotNull(), (F.col("gender") == PRIVILEGED_GROUP).cast("int"))
    return encoder.transform(analysis).withColumn("gender", gender)


def run_raw_audit(spark: SparkSession, raw: str, out: str) -> dict[str, DataFrame]:
    good, bad = store.read_raw_checked(spark, raw)
    store.write_table(bad, f"{out}/quarantine")
    store.write_table(analysis_table(good), f"{out}/analysis")
    analysis = store.read_table_at(spark, f"{out}/analysis")
    encoder = CategoryEncoder(coded_columns(analysis)).fit(analysis)
    encoder.save(f"{out}/encoder")
    store.write_table(numeric_table(analysis, CategoryEncoder.load(spark, f"{out}/encoder")), f"{out}/numeric")
    return {name: store.read_table_at(spark, f"{out}/{name}") for name in ("quarantine", "analysis", "numeric")}


def code_new_rows(spark: SparkSession, raw: str, out: str) -> DataFrame:
    """A later raw file coded by the saved table of an earlier job (values unknown to it: -2)."""
    good, _ = store.read_raw_checked(spark, raw)
    return numeric_table(analysis_table(good), CategoryEncoder.load(spark, f"{out}/encoder"))


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    ap.add_argument("--raw", required=True)
    ap.add_argument("--out", required=True)
    ap.add_argument("--master", default=None)
    a = ap.parse_args(argv)
    from .session import get_session
    run_raw_audit(get_session(a.master), a.raw, a.out)


if __name__ == "__main__":
    main()
