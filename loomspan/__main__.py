"""``python -m loomspan index FOLDER INDEX | search INDEX QUERY | validate INDEX CASES |
stream FRAMES OUT | notes TRANSCRIPTS OUT``"""

from __future__ import annotations

import argparse
import datetime as dt

from loomspan.plans import jobs
from loomspan.session import session
from loomspan.sources import configs


def main(argv: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="loomspan")
    sub = top.add_subparsers(dest="job", required=True)
    p = sub.add_parser("index")
    p.add_argument("folder")
    p.add_argument("index")
    p.add_argument("--prune", action="store_true")
    p = sub.add_parser("search")
    p.add_argument("index")
    p.add_argument("query")
    p.add_argument("--today", type=dt.date.fromisoformat)
    p.add_argument("--top", type=int, default=5)
    p = sub.add_parser("validate")
    p.add_argument("index")
    p.add_argument("cases")
    p.add_argument("--show", action="store_true")
    p = sub.add_parser("stream")
    p.add_argument("frames")
    p.add_argument("out")
    p.add_argument("--checkpoint")
    p.add_argument("--idle", type=int, default=60_000)
    p.add_argument("--tick")
    p = sub.add_parser("notes")
    p.add_argument("transcripts")
    p.add_argument("out")
    p.add_argument("--language", default="tr")
    args = top.parse_args(argv)
    spark = session()
    if args.job == "index":
        print(jobs.build(spark, args.folder, args.index, prune=args.prune))
    elif args.job == "search":
        asked = spark.createDataFrame([(1, args.query, args.today)], "query_id long, query string, today date")
        jobs.search(jobs.read(spark, args.index), asked, top=args.top).orderBy("place").show(args.top, truncate=False)
    elif args.job == "stream":
        query = jobs.listen(spark, args.frames, args.out, args.checkpoint or f"{args.out}-checkpoint", args.idle, args.tick)
        if args.tick:
            query.awaitTermination()
    elif args.job == "notes":
        jobs.minutes(spark, args.transcripts, args.out, target=args.language).show(1000, truncate=False)
    else:
        metrics, first = jobs.validate(jobs.read(spark, args.index), configs.cases(spark, args.cases))
        metrics.show()
        if args.show:
            first.show(1000, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
