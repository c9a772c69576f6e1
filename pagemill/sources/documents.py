"""Writing assembled documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.operators.documents import assemble_documents

TEXT_FORMATS = ("text", "markdown")


def write_document(pages: DataFrame, path: str, fmt: str = "markdown") -> None:
    """Writes the documents of ``pages``.

    Text formats give one folder per job and part holding the plain text, for
    delivery of chosen jobs. Any other format is a Spark table of (job_id,
    part, pages, content), which suits whole corpora.
    """
    docs = assemble_documents(pages)
    if fmt not in TEXT_FORMATS:
        docs.write.mode("overwrite").format(fmt).save(path)
        return
    # The text writer ends each row with one line feed of its own.
    body = F.regexp_replace("content", r"\n\z", "")
    (
        docs.select("job_id", "part", body.alias("value"))
        .repartition("job_id", "part")
        .write.mode("overwrite")
        .partitionBy("job_id", "part")
        .text(path)
    )
