"""python -m quarrykit list | build FOLDER | run QUERY FOLDER [--out PATH] | ask FOLDER REPO QUESTION"""

from __future__ import annotations

import argparse


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="quarrykit", description=__doc__)
    sub = p.add_subparsers(dest="what", required=True)
    sub.add_parser("list", help="names of all queries")
    sub.add_parser("build", help="write the index of a folder").add_argument("folder")
    run = sub.add_parser("run", help="run a query over a folder; the result is shown, or written as Parquet")
    run.add_argument("query")
    run.add_argument("folder")
    run.add_argument("--out")
    ask = sub.add_parser("ask", help="answer one question with the stand-in")
    for a in ("folder", "repo", "question"):
        ask.add_argument(a)
    o = p.parse_args(argv)

    from quarrykit.plans import catalogue

    if o.what == "list":
        print("\n".join(sorted(catalogue.queries())))
        return
    from quarrykit import api
    from quarrykit.session import session

    spark = session("quarrykit")
    if o.what == "build":
        for name, rows in api.build_index(spark, o.folder).items():
            print(name, rows)
    elif o.what == "run":
        df = catalogue.queries()[o.query](spark, o.folder)
        df.write.mode("errorifexists").parquet(o.out) if o.out else df.show(50, truncate=120)
    else:
        q = spark.createDataFrame([(1, o.repo, o.question)], "question_id BIGINT, repo STRING, question STRING")
        got = api.answer(spark, o.folder, q)
        for name in ("answers", "claims"):
            got[name].show(truncate=160)
        got["evidence"].select("rank", "path", "start_line", "end_line", "reason").orderBy("rank").show(truncate=120)


if __name__ == "__main__":
    main()
