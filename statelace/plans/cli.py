"""Command line: python -m statelace.plans.cli --samples PARQUET --fs HZ --output FOLDER [--config INI] [stages]."""

from __future__ import annotations

import argparse

from statelace.session import session
from statelace.sources import config, files

from .pipeline import Study


def parse(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="statelace")
    p.add_argument("--samples", required=True, help="Parquet with recording_id, sample_ix, topo")
    p.add_argument("--fs", type=float, required=True, help="samples per second")
    p.add_argument("--output", required=True)
    p.add_argument("--config", help="INI file")
    p.add_argument("--k", type=int)
    p.add_argument("--k-min", type=int)
    p.add_argument("--k-max", type=int)
    p.add_argument("--method", choices=("dot", "cosine", "correlation"))
    p.add_argument("--repeats", type=int)
    p.add_argument("--criterion", help="one criterion for k, or majority_vote")
    p.add_argument("--backfit-to", choices=("all", "peaks"))
    p.add_argument("--filter", choices=("remove", "replace_high", "replace_half", "smooth", "none"))
    p.add_argument("--filter-method", choices=("fir", "iir", "fft"))
    p.add_argument("--channels", help="names of the channels, joined by commas; samples are then referenced, filtered and resampled")
    a = p.parse_args(argv)
    if a.k is not None and a.k < 2:
        p.error("--k must be 2 or more")
    return a


def main(argv: list[str] | None = None) -> int:
    from dataclasses import replace

    a = parse(argv)
    spark = session()
    base = config.Settings()
    if a.config:
        base = config.loads("\n".join(r["value"] for r in spark.read.text(a.config, wholetext=True).collect()))
    given = {n: v for n in ("k", "k_min", "k_max", "method", "repeats", "criterion", "backfit_to", "filter", "filter_method") if (v := getattr(a, n)) is not None}
    study = Study(spark.read.parquet(a.samples), a.fs, replace(base, **given), a.channels.split(",") if a.channels else None)
    for name, r in study.run().items():
        print(name, "done" if r.ok else f"failed: {r.message}")
    if all(r.ok for r in study.results.values()):
        files.write_features(study.results["features"].payload, a.output, "real", "averaged")
    return int(not all(r.ok for r in study.results.values()))


if __name__ == "__main__":
    raise SystemExit(main())
