"""Mail files and JSON lines as tables."""

from __future__ import annotations

import datetime
import email
import email.policy
import email.utils
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

MAIL = "path string, message_id string, subject string, from_addr string, to_addr string, in_reply_to string, references array<string>, received_at timestamp, body_text string, body_html string, attachments array<struct<filename:string,content_type:string,bytes:long>>, raw_hash string, error string"


def parse(raw: bytes) -> dict:
    """The columns of one mail; what cannot be read is null, and ``error`` says why."""
    out: dict = {"raw_hash": hashlib.sha256(raw).hexdigest(), "references": [], "attachments": [], "error": None}
    try:
        mail = email.message_from_bytes(raw, policy=email.policy.default)
        for column, header in (("message_id", "Message-ID"), ("subject", "Subject"), ("from_addr", "From"), ("to_addr", "To"), ("in_reply_to", "In-Reply-To")):
            value = mail.get(header)
            out[column] = str(value).strip() if value is not None else None
        out["references"] = str(mail.get("References") or "").split()
        when = mail.get("Date")
        try:
            out["received_at"] = email.utils.parsedate_to_datetime(str(when)).astimezone(datetime.UTC) if when else None
        except (TypeError, ValueError):
            out["received_at"] = None
        for part in mail.walk():
            if part.is_multipart():
                continue
            name = part.get_filename()
            if name or part.get_content_disposition() == "attachment":
                out["attachments"].append({"filename": name, "content_type": part.get_content_type(), "bytes": len(part.get_payload(decode=True) or b"")})
            elif part.get_content_type() == "text/plain" and "body_text" not in out:
                out["body_text"] = part.get_content()
            elif part.get_content_type() == "text/html" and "body_html" not in out:
                out["body_html"] = part.get_content()
    except (LookupError, ValueError, KeyError, AttributeError, email.errors.MessageError) as e:
        out["error"] = f"{type(e).__name__}: {e}"
    return out


def read_mail(spark: SparkSession, path: str, most_bytes: int = 25 << 20) -> DataFrame:
    """One row a mail file under ``path``; files over ``most_bytes`` are listed with an error and not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.eml").option("recursiveFileLookup", "true").load(path)
    shape = to_arrow_schema(StructType.fromDDL(MAIL))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pylist([{"path": p} | parse(c) for p, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())], schema=shape)

    read = files.where(F.col("length") <= most_bytes).select("path", "content").mapInArrow(rows, MAIL)
    large = files.where(F.col("length") > most_bytes).select("path", F.lit("too large").alias("error"))
    return read.unionByName(large, allowMissingColumns=True)


def read_json_lines(spark: SparkSession, path: str, schema: StructType | str) -> tuple[DataFrame, DataFrame]:
    """(rows, malformed lines): a line that is no JSON object of the schema goes to the second table."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    shape = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    parsed = lines.select("value", F.from_json("value", shape.add("_bad", "string"), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    return parsed.where("r._bad is null").select("r.*").drop("_bad"), parsed.where("r._bad is not null").select("value")
