"""Reading and writing: chat texts, JSON state, order tables, reports. Schemas are declared, never inferred."""

from __future__ import annotations

import io
import json
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identity import ROW_FIELDS
from ..functions.text import number, strip

#: The stored columns, and the names that reports show them by.
DISPLAY = {
    "tgl_ro": "Tgl RO", "tgl_muat": "Tgl Muat", "pickup": "Pickup", "tujuan": "Tujuan", "no_plat": "No. Plat", "type_truck": "Type Truck",
    "driver": "Driver", "kontak_driver": "Kontak Driver", "job_number": "Job Number", "status_unit": "status_unit",
}
CHATS = "id string, chat_hash string, chat_text string, created_at timestamp, extraction_elapsed_ms double, extraction_run_id string, extraction_run_elapsed_ms double"
ORDERS = "id string, raw_chat_id string, row_hash string, " + ", ".join(f"{c} string" for c in ("job_number", *ROW_FIELDS, "status_unit")) + ", month_segment int, year_segment int, batch_row_order int, created_at timestamp"
AUDITS = "raw_chat_id string, candidate_key string, candidate_summary string, order_state_text string, incoming_text string, predicted_label string, p_match double, p_no_match double, confidence double, action string, decision_status string, policy_reason string, before_rows_json string, after_rows_json string, incoming_rows_json string, candidate_rows_json string, qty_target int, fill int, overflow int, duplicates int, review_required boolean, created_at timestamp"
PAIRS = "pair_id string, text_a string, text_b string, label string, pair_kind string, source_id string"
TRUTH = "text_a string, text_b string, label string"
SPAN_ROWS = "array<map<string,string>>"


def read_chats(spark: SparkSession, path: str) -> DataFrame:
    """A row a file: path, chat_text (the whole export, without a byte order mark)."""
    texts = spark.read.text(path, wholetext=True)
    return texts.select(F.input_file_name().alias("path"), F.replace(F.col("value"), F.lit("﻿"), F.lit("")).alias("chat_text"))


def read_json_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON array of objects; broken records have nulls."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)


def read_json_state(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON object as one row of `state`; what does not parse is null."""
    return spark.read.text(path, wholetext=True).select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("state"))


def read_csv_orders(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Exported tables: all columns text, cells of several lines."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def json_list(c) -> object:
    """JSON text of a list of objects; anything else is the empty list."""
    return F.coalesce(F.from_json(c, SPAN_ROWS), F.array().cast(SPAN_ROWS))


def training_logs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Training and evaluation rows of the state file with the greatest step, of equals the last path."""
    schema = "global_step long, best_metric double, log_history array<map<string,double>>"
    states = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.from_json("value", schema).alias("s"))
    step = F.coalesce("s.global_step", F.regexp_extract("path", r"checkpoint-(\d+)", 1).try_cast("long"), F.lit(-1))
    latest = states.agg(F.max_by("s", F.struct(step, "path")).alias("s"))
    logs = latest.select(F.explode("s.log_history").alias("log"))
    return logs.where("log['loss'] is not null"), logs.where(F.exists(F.map_keys("log"), lambda k: k.startswith("eval_")))


def to_display(rows: DataFrame, order: str) -> DataFrame:
    """Stored names as shown ones, with a running number."""
    from ..plans.numbering import numbered

    return numbered(rows, order, name="_no").select(F.col("_no").alias("No."), *(F.col(a).alias(b) for a, b in DISPLAY.items()))


def to_stored(rows: DataFrame) -> DataFrame:
    """Shown or stored names, whichever are there, as stored ones; what is missing is empty."""
    have = set(rows.columns)

    def one(a: str, b: str):
        found = [F.col(f"`{n}`") for n in (a, b) if n in have]
        return strip(F.coalesce(*found, F.lit(""))).alias(a)

    return rows.select(*(one(a, b) for a, b in DISPLAY.items() if a != b), *([one("status_unit", "status_unit")]))


def aligned(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The columns in this order, missing ones empty."""
    return rows.select(*(F.col(f"`{c}`") if c in rows.columns else F.lit("").alias(c) for c in columns))


def latest(chats: DataFrame) -> DataFrame:
    return chats.orderBy(F.desc("created_at"), F.desc("id")).limit(1)


def audits(table: DataFrame, n: int = 100) -> DataFrame:
    """The newest audit rows, JSON read, with 1 - p_match where p_no_match is missing."""
    newest = table.orderBy(F.desc("created_at")).limit(max(1, n))
    json_columns = [c for c in table.columns if c.endswith("_rows_json")]
    return newest.withColumns({c.removesuffix("_json"): json_list(F.col(c)) for c in json_columns} | {"p_no_match": F.coalesce("p_no_match", F.greatest(F.lit(0.0), 1 - number(F.col("p_match"))))})


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def append_audits(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def upper_cells(rows: DataFrame) -> DataFrame:
    """Every cell as text in upper case, nulls empty: the spreadsheet export."""
    return rows.select(*(F.upper(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))).alias(c) for c in rows.columns))


def column_widths(rows: DataFrame) -> DataFrame:
    return rows.agg(*(F.least(F.max(F.length(F.col(f"`{c}`").cast("string"))) + 4, F.lit(40)).alias(c) for c in rows.columns))


def markdown(rows: DataFrame, limit: int = 1000) -> str:
    """A small report table (at most `limit` rows) as Markdown."""
    head = "| " + " | ".join(rows.columns) + " |\n|" + "---|" * len(rows.columns)
    return "\n".join([head, *("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows.limit(limit).collect())])


def proof(rows: DataFrame, *columns: str) -> DataFrame:
    """A JSON text a row, NaN as null, for audits."""
    kinds = dict(rows.dtypes)
    return rows.select(F.to_json(F.struct(*(F.when(~F.isnan(c), F.col(c)).alias(c) if kinds[c] == "double" else F.col(c) for c in columns)), {"ignoreNullFields": "false"}).alias("proof"))


def export_bundle(session: dict, orders: DataFrame, chats: DataFrame, audit: DataFrame) -> bytes:
    """A session as a zip: session.json, orders.csv, raw_chats.json, stage2_audits.json and a manifest of counts. For one session's own
    tables, which are as small as what its user typed; rows stream to the driver."""
    out, counts = io.BytesIO(), {}
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("session.json", json.dumps(session, default=str))
        for name, df in (("orders.csv", orders), ("raw_chats.json", chats), ("stage2_audits.json", audit)):
            n = 0
            with z.open(name, "w") as f:
                if name.endswith("csv"):
                    f.write((",".join(df.columns) + "\n").encode())
                for r in df.toLocalIterator():
                    n += 1
                    line = ",".join('"' + str("" if v is None else v).replace('"', '""') + '"' for v in r) if name.endswith("csv") else json.dumps(r.asDict(True), default=str)
                    f.write((line + "\n").encode())
            counts[name] = n
        z.writestr("manifest.json", json.dumps(counts))
    return out.getvalue()


def to_rows(spark: SparkSession, rows) -> DataFrame:
    """A DataFrame as it is; a list of dictionaries as a table of texts whose columns are all their keys, in order of first appearance."""
    if isinstance(rows, DataFrame):
        return rows
    names = list(dict.fromkeys(k for r in rows for k in r))
    return spark.createDataFrame([tuple(None if r.get(n) is None else str(r[n]) for n in names) for r in rows], ", ".join(f"`{n}` string" for n in names) or "empty string")


def _files(spark: SparkSession, path: str):
    """The file system of a path, and the path."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def checkpoint_of_step(spark: SparkSession, root: str, step: int | None) -> str | None:
    """The folder of a training step, if it is there; on any file system that Spark reads."""
    if step is None or step < 0:
        return None
    path = f"{root.rstrip('/')}/checkpoint-{int(step)}"
    fs, where = _files(spark, path)
    return path if fs.exists(where) else None


METRICS = "ner_cumulative_ms double, match_cumulative_ms double"


def record_metrics(spark: SparkSession, path: str, ner_ms: float, match_ms: float = 0.0) -> None:
    """Keeps the last two timings; each call replaces them."""
    spark.createDataFrame([(float(ner_ms), float(match_ms))], METRICS).coalesce(1).write.mode("overwrite").json(path)


def cumulative_metrics(spark: SparkSession, path: str) -> tuple[float, float]:
    """The timings kept, zeros where there are none or they cannot be read."""
    fs, where = _files(spark, path)
    row = spark.read.schema(METRICS).json(path).first() if fs.exists(where) else None
    return (row[0] or 0.0, row[1] or 0.0) if row else (0.0, 0.0)


def reset_metrics(spark: SparkSession, path: str) -> None:
    fs, where = _files(spark, path)
    fs.delete(where, True)


#: Rows of a spreadsheet at most, by its format.
SHEET_ROWS = 1_048_576


def spreadsheet(rows: DataFrame, sheet: str = "Sheet1") -> bytes:
    """A report as the bytes of an .xlsx file: upper-case cells, a bold head, widths by the longest cell. Rows stream to the driver, as a
    spreadsheet is one file; more than the format holds is an error."""
    from xml.sax.saxutils import escape, quoteattr

    shown = upper_cells(rows)
    widths = column_widths(shown).first() if shown.columns else ()
    out, main = io.BytesIO(), "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    package, office = "http://schemas.openxmlformats.org/package/2006", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    link = lambda k, kind, target: f'<Relationship Id="rId{k}" Type="{office}/{kind}" Target="{target}"/>'
    xml = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'

    def line(n: int, cells, style: str = "") -> bytes:
        body = "".join(f'<c t="inlineStr"{style}><is><t xml:space="preserve">{escape("".join(ch for ch in str(v) if ch >= " " or ch in "\t\n"))}</t></is></c>' for v in cells)
        return f'<row r="{n}">{body}</row>'.encode()

    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        kinds = (("/xl/workbook.xml", "sheet.main"), ("/xl/worksheets/sheet1.xml", "worksheet"), ("/xl/styles.xml", "styles"))
        parts = "".join(f'<Override PartName="{p}" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.{k}+xml"/>' for p, k in kinds)
        z.writestr("[Content_Types].xml", f'{xml}<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>{parts}</Types>')
        z.writestr("_rels/.rels", f'{xml}<Relationships xmlns="{package}/relationships">{link(1, "officeDocument", "xl/workbook.xml")}</Relationships>')
        z.writestr("xl/_rels/workbook.xml.rels", f'{xml}<Relationships xmlns="{package}/relationships">{link(1, "worksheet", "worksheets/sheet1.xml")}{link(2, "styles", "styles.xml")}</Relationships>')
        z.writestr("xl/workbook.xml", f'{xml}<workbook xmlns="{main}" xmlns:r="{office}"><sheets><sheet name={quoteattr(sheet[:31])} sheetId="1" r:id="rId1"/></sheets></workbook>')
        fonts = '<fonts count="2"><font/><font><b/></font></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs>'
        z.writestr("xl/styles.xml", f'{xml}<styleSheet xmlns="{main}">{fonts}<cellXfs count="2"><xf/><xf fontId="1" applyFont="1"/></cellXfs></styleSheet>')
        with z.open("xl/worksheets/sheet1.xml", "w") as f:
            cols = "".join(f'<col min="{i}" max="{i}" width="{max(w or 0, len(c) + 2)}" customWidth="1"/>' for i, (w, c) in enumerate(zip(widths, shown.columns), 1))
            f.write(f'{xml}<worksheet xmlns="{main}">{f"<cols>{cols}</cols>" if cols else ""}<sheetData>'.encode())
            f.write(line(1, shown.columns, ' s="1"'))
            for n, row in enumerate(shown.toLocalIterator(), 2):
                if n > SHEET_ROWS:
                    raise ValueError(f"more than {SHEET_ROWS - 1} rows")
                f.write(line(n, row))
            f.write(b"</sheetData></worksheet>")
    return out.getvalue()


def operational(rows: DataFrame, enabled: bool = False) -> DataFrame:
    """The export's rules, which are off unless asked for: canonical request and loading dates, and all cells in upper case."""
    from ..functions import dates

    if not enabled:
        return rows
    day = dates.canonical_date(F.col("tgl_ro"))
    dated = rows.withColumns({"tgl_ro": day, "tgl_muat": dates.loading_date(F.col("tgl_muat"), day)})
    return dated.withColumns({c: F.upper(F.coalesce(c, F.lit(""))) for c in ROW_FIELDS if c in rows.columns})
