"""Command line: python -m tidewright COMMAND FILE --time t ..."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from .frames import KEY, TIME, validated, value_columns
from .operators import profile, regime
from .plans import discovery, worlds
from .sources.readers import read_frame


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="tidewright")
    p.add_argument("command", choices=["profile", "discover", "regimes", "simulate", "backtest"])
    p.add_argument("file")
    p.add_argument("--time", default="t")
    p.add_argument("--series")
    p.add_argument("--state", default="", help="comma-separated; all value columns where it is left out")
    p.add_argument("--degree", type=int, default=2)
    p.add_argument("--threshold", type=float, default=0.05)
    p.add_argument("--solver", default="stlsq", choices=["stlsq", "sr3", "lasso", "nnls", "frols", "ssr"])
    p.add_argument("--steps", type=int, default=100)
    p.add_argument("--step", type=float, default=0.01)
    a = p.parse_args(args)
    spark = spark or SparkSession.builder.getOrCreate()
    df = validated(read_frame(spark, a.file, a.time, a.series))
    states = [s for s in a.state.split(",") if s] or value_columns(df)
    if a.command == "profile":
        out = [r.asDict() for r in profile.columns_profile(df, states).collect()] + [r.asDict() for r in profile.time_profile(df).collect()]
    elif a.command == "regimes":
        out = [r.asDict() for r in regime.segments(df, states[0]).orderBy(KEY, "segment").collect()]
    elif a.command == "backtest":
        out = [r.asDict() for r in discovery.backtest(df, states[0], 10, 5).orderBy(KEY, "origin").collect()]
    else:
        options = {"threshold": a.threshold} if a.solver in ("stlsq", "sr3") else {}
        world = discovery.discover(df, states, degree=a.degree, solver=a.solver, **options)
        out = json.loads(worlds.to_json(world)) | {"scores": world.scores, "fingerprint": worlds.fingerprint(world)}
        if a.command == "simulate":
            first = df.orderBy(TIME).select(*states).first()
            out["trajectory"] = discovery.trajectory(world, list(first), a.step, a.steps).tolist()
    print(json.dumps(out, default=str))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
