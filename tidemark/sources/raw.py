"""Raw files: CSV tables with declared schemas, append and rewrite, documents with front matter, and a warehouse of them all."""

from __future__ import annotations

import csv
import hashlib
import io
import uuid
from dataclasses import dataclass, field
from datetime import date, datetime
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.conform import conform_field, conform_keys, fiscal_calendar, flag_tests, watermarks
from tidemark.plans.panel import Fact, Model

# The raw tables by source, with the columns of their files in order.
TABLES: dict[str, dict[str, str]] = {
    "billing": {
        "invoice": "invoice_id string, account_id string, invoice_date date, currency string, amount_gross double, amount_net double, _ingested_at timestamp_ntz",
        "invoice_line": "invoice_id string, line_no long, invoice_date date, account_id string, product_id string, region string, qty long, unit_price double, amount_gross double, discount double, amount_net double, currency string, is_recurring int, contract_start date, contract_end date, _ingested_at timestamp_ntz",
        "credit_note": "credit_id string, credit_date date, invoice_id string, account_id string, amount double, reason_code string, _ingested_at timestamp_ntz",
        "price_book": "product_id string, segment string, effective_from date, effective_to date, list_price double",
    },
    "crm": {
        "account": "account_id string, account_name string, region string, segment string, industry string, owner_user_id string, first_contract_date date, csm_user_id string, _synced_at timestamp_ntz",
        "opportunity": "opp_id string, account_id string, type string, stage string, arr_value double, created_at date, close_date date, closed_won int, lost_reason_code string, owner_user_id string, _synced_at timestamp_ntz",
        "opportunity_note": "note_id string, opp_id string, account_id string, author_user_id string, created_at timestamp_ntz, body_text string",
        "renewal": "renewal_id string, account_id string, arr_up_for_renewal double, arr_renewed double, due_date date, closed_date date, outcome string",
    },
    "product_ops": {
        "ticket": "ticket_id string, account_id string, priority string, category string, created_at timestamp_ntz, first_response_at timestamp_ntz, resolved_at timestamp_ntz, status string, subject string, body_text string",
        "ticket_message": "message_id string, ticket_id string, author_user_id string, created_at timestamp_ntz, body_text string",
        "news_item": "news_id string, published_at timestamp_ntz, source string, competitor string, region string, headline string, body_text string",
        "deploy_event": "deploy_id string, service string, deployed_at timestamp_ntz, version string, change_summary string, affected_regions string",
        "incident": "incident_id string, service string, started_at timestamp_ntz, resolved_at timestamp_ntz, severity string, affected_accounts string",
    },
}
# The column that places a row in a period, and the one that says when it came in.
PERIODS = {"invoice": "invoice_date", "invoice_line": "invoice_date", "credit_note": "credit_date", "opportunity": "close_date", "renewal": "closed_date", "ticket": "created_at", "deploy_event": "deployed_at", "incident": "started_at"}
INGESTED = {
    "invoice": "_ingested_at", "invoice_line": "_ingested_at", "credit_note": "_ingested_at", "account": "_synced_at", "opportunity": "_synced_at",
    "ticket": "created_at", "ticket_message": "created_at", "news_item": "published_at", "deploy_event": "deployed_at", "incident": "started_at",
}


def _files(spark: SparkSession, path: str):
    of = spark._jvm.org.apache.hadoop.fs.Path
    return of, of(path).getFileSystem(spark._jsc.hadoopConfiguration())


def folders(spark: SparkSession, path: str) -> list[str]:
    """The names of what is in a folder, none if it isn't there."""
    of, fs = _files(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(of(path))) if exists(spark, path) else []


def removed(spark: SparkSession, path: str) -> None:
    of, fs = _files(spark, path)
    fs.delete(of(path), True)


def put_new(spark: SparkSession, path: str, text: str) -> bool:
    """Makes a small file that is whole at once, unless there is one of that name: whether this one was first."""
    jvm, (of, fs) = spark._jvm, _files(spark, path)
    aside = of(f"{path}.{uuid.uuid4().hex}")
    out = fs.create(aside, False)
    out.write(bytearray(text.encode()))
    out.close()
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(of(path).toUri(), spark._jsc.hadoopConfiguration()).rename(aside, of(path), spark.sparkContext._gateway.new_array(rename, 0))
        return True
    except Py4JJavaError:
        fs.delete(aside, False)
        if fs.exists(of(path)):
            return False
        raise


def _renamed(fs, source, target) -> None:
    """Hadoop's rename says false where others raise."""
    if not fs.rename(source, target):
        raise OSError(f"{source} couldn't be renamed to {target}")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is something at path; where a replacement broke off between its two renames, the old folder is put back first."""
    of, fs = _files(spark, path)
    if not fs.exists(of(path)) and fs.exists(of(f"{path}.old")):
        _renamed(fs, of(f"{path}.old"), of(path))
    return fs.exists(of(path))


def replaced(spark: SparkSession, path: str) -> None:
    """Puts the folder path.new in the place of path. At each moment one of the two is whole under path or path.old.

    A rename that fails raises and leaves both; the next call of this or of exists() goes on from there.
    """
    of, fs = _files(spark, path)
    if not fs.exists(of(f"{path}.new")):
        raise FileNotFoundError(f"{path}.new")
    if exists(spark, path):
        if fs.exists(of(f"{path}.old")):
            fs.delete(of(f"{path}.old"), True)  # of a replacement that was whole but for this
        _renamed(fs, of(path), of(f"{path}.old"))
    _renamed(fs, of(f"{path}.new"), of(path))
    fs.delete(of(f"{path}.old"), True)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV file or folder with a header, by a declared schema; an empty field is null. A missing path is an error."""
    if not exists(spark, path):
        raise FileNotFoundError(path)
    return spark.read.option("timestampNTZFormat", "yyyy-MM-dd[ ]['T']HH:mm:ss[.SSSSSS]").csv(path, header=True, schema=schema, enforceSchema=False)


def read_raw(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {t: read_csv(spark, f"{folder}/{source}/{t}.csv", schema) for source, of in TABLES.items() for t, schema in of.items()}


def append_csv(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("header", True).option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").csv(path)


def rewrite_csv(df: DataFrame, path: str) -> None:
    """Replaces a CSV folder by rows that may come from it: written beside it first, then swapped."""
    df.write.mode("overwrite").option("header", True).option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").csv(f"{path}.new")
    replaced(df.sparkSession, path)


def digest(df: DataFrame) -> DataFrame:
    """One row: n_rows and a digest that doesn't depend on the order of rows."""
    row = F.xxhash64(*(F.col(c) for c in df.columns))
    return df.agg(F.count("*").alias("n_rows"), F.bit_xor(row).alias("xor_digest"), F.sum(F.pmod(row, F.lit(1 << 31))).alias("sum_digest"))


def write_text(path: Path | str, text: str) -> str:
    """A report or another small file of the driver, with \\n line ends; its SHA-256."""
    Path(path).write_bytes(raw := text.encode())
    return hashlib.sha256(raw).hexdigest()


def _cell(value: object) -> str:
    return "" if value is None else str(value).lower() if isinstance(value, bool) else str(value)


def write_fixture(tables: dict[str, DataFrame], folder: Path | str) -> dict[str, str]:
    """Small tables as CSV files of the driver, folder/name.csv, and the SHA-256 of each by name, which manifest.sha256 lists too.

    Rows are ordered by all their columns, nulls first, so equal rows make equal files however they are partitioned. A
    null is an empty field, as is an empty string. Rows go through the driver one partition at a time.
    """
    out = {}
    for name, df in sorted(tables.items()):
        text = io.StringIO()
        to = csv.writer(text, lineterminator="\n")
        to.writerow(df.columns)
        to.writerows([_cell(v) for v in r] for r in df.orderBy(*df.columns).toLocalIterator())
        (at := Path(folder) / f"{name}.csv").parent.mkdir(parents=True, exist_ok=True)
        out[name] = write_text(at, text.getvalue())
    write_text(Path(folder) / "manifest.sha256", "".join(f"{h}  {n}.csv\n" for n, h in out.items()))
    return out


def read_documents(spark: SparkSession, glob: str, required: tuple[str, ...] = ("doc_id", "table", "date", "role")) -> DataFrame:
    """Markdown files with front matter between --- lines: fields, a map, and body. A missing key or a repeated doc_id is an error."""
    text = spark.read.text(glob, wholetext=True).select(F.input_file_name().alias("path"), F.regexp_replace("value", "\r\n", "\n").alias("value"))
    parts = text.select("path", F.regexp_extract("value", r"(?s)^---\n(.*?)\n---\n?(.*)$", 1).alias("front"), F.btrim(F.regexp_extract("value", r"(?s)^---\n(.*?)\n---\n?(.*)$", 2), F.lit(" \t\n")).alias("body"))
    pairs = F.transform(F.filter(F.split("front", "\n"), lambda x: F.instr(x, ":") > 0), lambda x: F.struct(F.trim(F.regexp_extract(x, r"^([^:]*):", 1)).alias("key"), F.trim(F.regexp_extract(x, r"^[^:]*:(.*)$", 1)).alias("value")))
    out = parts.select("path", F.map_from_entries(pairs).alias("fields"), "body")
    lacking = F.array(*(F.when(F.col("fields")[k].isNull(), F.lit(k)) for k in required))
    if bad := out.select("path", F.array_compact(lacking).alias("keys")).where(F.size("keys") > 0).head(1):
        raise ValueError(f"{bad[0].path} lacks {', '.join(bad[0]['keys'])}")
    if twice := out.groupBy(F.col("fields")["doc_id"].alias("doc_id")).count().where("count > 1").head(1):
        raise ValueError(f"document {twice[0].doc_id} is there twice")
    return out


@dataclass(frozen=True)
class Warehouse:
    tables: dict[str, DataFrame]
    calendar: DataFrame
    watermark: DataFrame
    overrides: DataFrame
    as_of: datetime
    views: dict[str, DataFrame] = field(default_factory=dict)

    def model(self) -> Model:
        facts = {t: Fact(self.tables[t], p, INGESTED.get(t)) for t, p in PERIODS.items()}
        return Model(facts, self.tables["account"], self.calendar, {"test_account": self.tables["account"].where("is_test").select("account_id")})


def build(spark: SparkSession, folder: str, alias: DataFrame, tests: DataFrame, as_of: datetime, history: tuple[date, date]) -> Warehouse:
    """Reads and conforms all raw tables; a pure function of its arguments, so a rebuild is a call."""
    raw = read_raw(spark, folder)
    account = flag_tests(raw["account"], tests)
    tables = dict(raw) | {"account": account}
    for name in ("invoice", "invoice_line", "credit_note"):
        tables[name] = conform_keys(raw[name], alias, "billing", required=name == "invoice_line")
    tables["invoice_line"] = conform_field(tables["invoice_line"], account, "account_id", "region")
    overrides = tables["invoice_line"].agg(F.count_if("overridden").alias("overridden")).select(F.lit("invoice_line").alias("relation"), F.lit("region").alias("field"), "overridden")
    tables["invoice_line"] = tables["invoice_line"].drop("overridden")
    sources = {t: (source, raw[t], INGESTED.get(t)) for source, of in TABLES.items() for t in of}
    return Warehouse(tables, fiscal_calendar(spark, *history), watermarks(sources, as_of), overrides, as_of)


#: The frames of a warehouse that aren't one of its raw tables, as they are named when it is saved.
_BESIDE = ("calendar", "watermark", "overrides")


def save(warehouse: Warehouse, folder: str) -> None:
    """Writes a warehouse as Parquet, a folder a table, in the place of what was there; keys are conformed once for all reads.

    Tables with a period are dealt out and ordered by its column, so that a range of days reads few row groups; days with
    many rows are split by a hash of the row. The old warehouse stays readable until all of the new one is written.
    """
    spark = warehouse.calendar.sparkSession
    for name, df in {**warehouse.tables, **{n: getattr(warehouse, n) for n in _BESIDE}}.items():
        if name in PERIODS:
            df = df.repartitionByRange(F.col(PERIODS[name]), F.xxhash64(*df.columns)).sortWithinPartitions(PERIODS[name])
        df.write.mode("overwrite").parquet(f"{folder}.new/{name}")
    spark.createDataFrame([(warehouse.as_of,)], "as_of timestamp_ntz").write.mode("overwrite").parquet(f"{folder}.new/as_of")
    replaced(spark, folder)


def connect(spark: SparkSession, folder: str) -> Warehouse:
    """A saved warehouse, to be read only: nothing is conformed or checked again. A missing one is an error."""
    if not exists(spark, folder):
        raise FileNotFoundError(folder)
    read = lambda name: spark.read.parquet(f"{folder}/{name}")
    tables = {t: read(t) for of in TABLES.values() for t in of}
    return Warehouse(tables, *map(read, _BESIDE), read("as_of").first().as_of)
