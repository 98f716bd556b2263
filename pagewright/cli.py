"""Commands over a PDF file, or all of a folder's: python -m pagewright.cli pdf2md PATH [OUT] [--json] [--raw], or
detect PATH [--json]. They end with 0, 1 after an error, or 2 where OCR is needed (the highest of several files';
pdf2md --json knows no 2)."""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import documents
from .sources import pdf

# What a type is called.
TYPES = {
    "text_based": "TEXT-BASED (extractable text)",
    "scanned": "SCANNED (OCR needed)",
    "image_based": "IMAGE-BASED (mostly images, OCR may help)",
    "mixed": "MIXED (some text, some images)",
}


def _files(spark: SparkSession, path: str) -> DataFrame:
    return pdf.read_pdfs(spark, path)


def detect(spark: SparkSession, path: str, as_json: bool = False, out=print) -> int:
    """Prints what kinds of documents the files are."""
    start = time.time()
    docs = _files(spark, path)
    kinds = documents.recommendation(pdf.detect_pdf_types(docs)).join(docs.select("doc_id", "path"), "doc_id")
    record = documents.detection_json(kinds).withColumnRenamed("value", "record")
    worst = 0
    for r in kinds.join(record, "doc_id").orderBy("path").toLocalIterator():
        worst = max(worst, 1 if r["error"] else 0)
        if r["error"]:
            out('{"error":"%s"}' % r["error"]["message"].replace('"', '\\"') if as_json else f"Error: {r['error']['message']}")
        elif as_json:
            out(r["record"])
        else:
            out(
                f"PDF Type Detection Results\n==========================\nFile: {r['path']}\n\nType: {TYPES[r['pdf_type']]}\nConfidence: {r['confidence'] * 100:.0f}%\n\n"
                f"Page count: {r['page_count']}\nPages sampled: {r['pages_sampled']}\nPages with text: {r['pages_with_text']}\nOCR recommended: {'YES' if r['ocr_recommended'] else 'NO'}\n"
                + (f"Title: {r['title']}\n" if r["title"] is not None else "") + f"\nDetection time: {(time.time() - start) * 1000:.0f}ms\n\n{r['recommendation']}"
            )
    return worst


def pdf2md(spark: SparkSession, path: str, target: str | None = None, as_json: bool = False, raw: bool = False, out=print) -> int:
    """Prints Markdown, or writes it as text files to a folder; raw: nothing but the Markdown."""
    docs = _files(spark, path)
    results = documents.recommendation(documents.process_pdfs(docs)).join(docs.select("doc_id", "path"), "doc_id")
    if target and not as_json:
        results.where("markdown IS NOT NULL").select(F.col("markdown").alias("value")).write.mode("overwrite").option("lineSep", "\n\n").text(target)
    record = documents.processing_json(results).withColumnRenamed("value", "record")
    worst = 0
    for r in results.join(record, "doc_id").orderBy("path").toLocalIterator():
        failed = r["error"] is not None
        worst = max(worst, 1 if failed else 0 if as_json else r["exit_status"])
        if failed:
            out('{"error":"%s"}' % r["error"]["message"].replace('"', '\\"') if as_json else f"Error: {r['error']['message']}")
        elif as_json:
            out(r["record"])
        else:
            if not raw:
                out(f"File: {r['path']}\nType: {TYPES[r['pdf_type']]}\nPages: {r['page_count']}\n{r['recommendation']}")
            if r["markdown"] is not None and not target:
                out(r["markdown"])
    return worst


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="pagewright")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("pdf2md", "detect"):
        command = commands.add_parser(name)
        command.add_argument("path")
        command.add_argument("--json", action="store_true")
        if name == "pdf2md":
            command.add_argument("out", nargs="?")
            command.add_argument("--raw", action="store_true")
    args = parser.parse_args(argv)
    spark = spark or SparkSession.builder.appName("pagewright").getOrCreate()
    if args.command == "detect":
        return detect(spark, args.path, args.json)
    return pdf2md(spark, args.path, args.out, args.json, args.raw)


if __name__ == "__main__":
    sys.exit(main())
