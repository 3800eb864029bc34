"""Command line: the reference application's entry points as Spark jobs.

  python -m ragloom ingest  --metadata metadata.csv --images DIR --out DIR
  python -m ragloom search  --vectors VEC.parquet --images IMG.parquet --query-id 7 --k 5
  python -m ragloom rag     --queries Q.parquet --vectors VEC.parquet --images IMG.parquet --out DIR
  python -m ragloom report  --generations G.parquet --embeddings E.parquet --images I.parquet --out DIR

Tables are parquet folders with the schemas of ``ragloom.adapters``; every command writes its
result with the sinks and prints nothing but a one-line summary.
"""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F


def main(argv=None) -> None:
    ap = argparse.ArgumentParser(prog="ragloom")
    sub = ap.add_subparsers(dest="cmd", required=True)
    a = sub.add_parser("ingest")
    a.add_argument("--metadata", required=True)
    a.add_argument("--images", required=True)
    a.add_argument("--out", required=True)
    s = sub.add_parser("search")
    s.add_argument("--vectors", required=True)
    s.add_argument("--images", required=True)
    s.add_argument("--query-id", type=int, required=True)
    s.add_argument("--k", type=int, default=5)
    s.add_argument("--threshold", type=float, default=0.0)
    r = sub.add_parser("rag")
    r.add_argument("--queries", required=True)
    r.add_argument("--vectors", required=True)
    r.add_argument("--images", required=True)
    r.add_argument("--out", required=True)
    r.add_argument("--n", type=int, default=3)
    r.add_argument("--threshold", type=float, default=0.1)
    p = sub.add_parser("report")
    p.add_argument("--generations", required=True)
    p.add_argument("--embeddings", required=True)
    p.add_argument("--images", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--days", type=int, default=30)
    p.add_argument("--cache", default=None)
    args = ap.parse_args(argv)

    from .session import get_session
    spark = get_session()

    if args.cmd == "ingest":
        from .plans.ingest import csv_items, ingest
        from .sources import readers as R
        from .sources import sinks as K
        items = csv_items(R.read_metadata_csv(spark, args.metadata), args.images)
        files = R.list_files(spark, args.images)
        existing = spark.createDataFrame([], "image_path string")
        imgs, emb, _rejected = ingest(items, files, existing)
        K.write_table(imgs, f"{args.out}/images")
        K.write_table(emb, f"{args.out}/embeddings")
        print("ingest written to", args.out)
    elif args.cmd == "search":
        from .operators import joins, vectors
        corpus = spark.read.parquet(args.vectors)
        q = corpus.filter(F.col("id") == args.query_id).select("embedding").scalar()
        hits = vectors.cosine_topk(corpus, q, k=args.k, threshold=args.threshold)
        out = joins.enrich_hits(hits.select("image_id", "similarity_score"), spark.read.parquet(args.images),
                                hits_bounded=True)
        for row in out.select("image_id", "image_path", "similarity_score").collect():  # k rows
            print(row["image_id"], row["image_path"], round(row["similarity_score"], 6))
    elif args.cmd == "rag":
        from .plans.rag import rag_process
        from .sources import sinks as K
        res = rag_process(spark.read.parquet(args.queries), spark.read.parquet(args.vectors),
                          spark.read.parquet(args.images), n=args.n, threshold=args.threshold)
        K.write_table(res.select("qid", "original_query", "augmented_prompt", "n_examples"), args.out, mode="overwrite")
        print("augmented prompts written to", args.out)
    elif args.cmd == "report":
        from .plans.reports import analytics_report
        from .sources import sinks as K
        g = spark.read.parquet(args.generations)
        emb = spark.read.parquet(args.embeddings)
        cache = spark.read.parquet(args.cache) if args.cache else spark.createDataFrame([], "cache_key string")
        rep = analytics_report(spark.read.parquet(args.images), emb, g, cache, as_of=g.agg(F.max("created_at")),
                               days=args.days)
        K.write_report(rep, args.out, "json")
        print("report written to", args.out)


if __name__ == "__main__":
    main()
