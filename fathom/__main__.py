"""python -m fathom version | status | search | index-text | pack | validate"""

from __future__ import annotations

import argparse
import json
import os
import sys

from . import __version__


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="fathom")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("version")
    for name in ("status", "search", "index-text"):
        s = sub.add_parser(name)
        s.add_argument("--index", required=True, help="folder of the index")
        s.add_argument("--dim", type=int, default=64)
        s.add_argument("--hash-embedder", action="store_true", help="use the test embedder, which has no meaning")
        if name == "search":
            s.add_argument("query")
            s.add_argument("--limit", type=int, default=10)
        if name == "index-text":
            s.add_argument("path", help="a text file, a line each")
            s.add_argument("--title", default="")
    for name in ("pack", "validate"):
        s = sub.add_parser(name)
        s.add_argument("--corpus-identity", required=True)
        s.add_argument("--corpus-lines", required=True)
        s.add_argument("--dim", type=int, required=True)
        s.add_argument("--chunking-identity", type=int)
        s.add_argument("--records", required=True, help="snapshot folder")
        if name == "pack":
            s.add_argument("--vectors", required=True)
            s.add_argument("--inputs", required=True)
    a = p.parse_args(argv)
    if a.command == "version":
        print(__version__)
        return 0
    from pyspark.sql import SparkSession

    from .functions.hashing import ChunkerConfig, signed
    from .operators import packer
    from .plans.embedding import HashEmbedder
    from .plans.index import SemanticIndex
    from .plans.search import SearchEngine, SearchParams
    from .sources import corpus, snapshot
    from .sources.manifest_store import ManifestConfig

    spark = SparkSession.builder.appName("fathom").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    identity = ChunkerConfig().identity
    if a.command in ("pack", "validate"):
        identity = a.chunking_identity or identity
        lines = corpus.JsonCorpus(spark, a.corpus_identity, a.corpus_lines).lines()
        try:
            if a.command == "pack":
                records = packer.pack(corpus.read_vector_inputs(spark, a.vectors, a.inputs, a.dim), lines, a.dim, identity)
                snapshot.write(records, a.records, a.dim)
            records = snapshot.read(spark, a.records, a.dim)
            if records is None:
                raise packer.PackError("there is no snapshot")
            packer.validate(records, lines, identity)
        except ValueError as e:
            print(e, file=sys.stderr)
            return 1
        print(json.dumps({"records": records.count()}))
        return 0
    embedder = HashEmbedder(a.dim) if a.hash_embedder else None
    index = SemanticIndex(spark, a.index, ManifestConfig("hash" if embedder else "none", a.dim, signed(identity)), embedder)
    if a.command == "status":
        print(json.dumps(index.status().__dict__, default=list))
    elif a.command == "search":
        r = SearchEngine(spark, index).search(a.query, params=SearchParams(limit=a.limit))
        print(json.dumps({"mode": r.search_mode, "fallback": r.fallback_reason, "results": [{"line_id": x.line_id, "title": x.title, "score": x.fused_score} for x in r.results]}))
    else:
        from pyspark.sql import functions as F

        key = os.path.basename(a.path)
        with open(a.path, encoding="utf-8") as f:
            rows = [(key, k, k + 1, k // 5, t.rstrip("\n"), 0, f"{k + 1}", k) for k, t in enumerate(f)]
        lines = spark.createDataFrame(rows, "source_book_key string, ord int, line_id bigint, section_id bigint, text string, line_hash bigint, reference string, segment bigint")
        books = spark.createDataFrame([(key, a.title or key, 0, False, "/text", [])], "source_book_key string, title string, content_fingerprint bigint, is_pdf boolean, topics string, extra_facets array<string>")
        print(json.dumps(index.index_books(books, lines.withColumn("line_id", F.col("line_id") + (1 << 32))).__dict__))
    return 0


if __name__ == "__main__":
    sys.exit(main())
