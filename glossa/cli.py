"""Builds or validates study pages: python -m glossa.cli INPUT [OUTPUT] --template FILE [--force] [--validate-only].

INPUT may be a file, a folder or a pattern of JSON pages; OUTPUT ends in .html and becomes a folder with one text per page.
Exit code 0, or 2 with the first error.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from glossa.operators import quality, study
from glossa.sources import corpus_json, sinks


def run(spark: SparkSession, source: str, output: str | None, template: str | None, force: bool, validate_only: bool) -> list[str]:
    pages = corpus_json.study_pages(spark, source)
    bad = quality.study_page(pages).filter("error is not null").select("error").first()
    if bad:
        raise quality.InvalidInput(bad.error)
    counts = study.summary(pages).collect()
    lines = ["; ".join(f"{k}={v}" for k, v in r.asDict().items()) for r in counts]
    if validate_only:
        return ["valid: " + line for line in lines]
    if output is None or template is None:
        raise quality.InvalidInput("an output and a template are required unless pages are only validated")
    if not output.lower().endswith((".html", ".htm")):
        raise quality.InvalidInput("output names must end in .html or .htm")
    html = study.render(pages, corpus_json.template(spark, template))
    if html.filter(~study.rendered_ok(F.col("html"))).limit(1).count():
        raise quality.InvalidInput("a rendered page fails the structure check")
    sinks.write_text(html, output, "html", force)
    return [f"created: {output}", *lines]


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("source")
    parser.add_argument("output", nargs="?")
    parser.add_argument("--template")
    parser.add_argument("--force", action="store_true")
    parser.add_argument("--validate-only", action="store_true")
    a = parser.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    try:
        print("\n".join(run(spark, a.source, a.output, a.template, a.force, a.validate_only)))
    except Exception as e:  # noqa: BLE001  every failure is an exit code here
        print(f"error: {e}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
