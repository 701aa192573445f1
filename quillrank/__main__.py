"""Command line: ``python -m quillrank STAGE --help``."""

from __future__ import annotations

import argparse
import inspect
import json
import sys

from quillrank import pipeline
from quillrank.config import load_config
from quillrank.session import build_session

STAGES = {
    "fetch": pipeline.fetch, "clean": pipeline.clean, "split": pipeline.split, "features": pipeline.build_features, "recall": pipeline.recall, "evaluate": pipeline.evaluate,
    "submit": pipeline.submit, "infer-tsv": pipeline.infer_tsv, "infer-parquet": pipeline.infer_parquet, "score": pipeline.score_externally,
}


def parser() -> argparse.ArgumentParser:
    """One sub-command per stage; its options are the stage function's parameters."""
    top = argparse.ArgumentParser(prog="quillrank")
    stages = top.add_subparsers(dest="stage", required=True)
    for name, stage in STAGES.items():
        sub = stages.add_parser(name, help=(stage.__doc__ or "").strip().split("\n")[0].replace("%", "%%"))
        for p in list(inspect.signature(stage).parameters.values())[1:]:
            if p.name == "cfg":
                sub.add_argument("--config", required=True)
                sub.add_argument("--raw-dir", default=".")
                continue
            flag, default = "--" + p.name.replace("_", "-"), p.default
            if default is inspect.Parameter.empty:
                sub.add_argument(flag, required=True)
            elif isinstance(default, bool):
                sub.add_argument(flag, action="store_true")
            elif isinstance(default, tuple):
                sub.add_argument(flag, nargs="+", default=default)
            else:
                kind = type(default) if default is not None else (int if p.name == "limit" else str)
                sub.add_argument(flag, type=kind, default=default)
    top.add_argument("--master", default="local[*]")
    return top


def main(argv: list[str] | None = None) -> int:
    args = vars(parser().parse_args(argv))
    stage, master = STAGES[args.pop("stage")], args.pop("master")
    spark = build_session(master)
    if "config" in args:
        args["cfg"] = load_config(args.pop("config"), args.pop("raw_dir"))
    print(json.dumps(stage(spark, **args), indent=2, default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())
