"""Command line: run the evaluation suite, or show a configuration."""

from __future__ import annotations

import argparse
import datetime as dt
import json
import re
from pathlib import Path

SECRETS = re.compile(r"(?i)key|password|token|secret")


def redacted_config(config: dict) -> dict:
    """The configuration with secret values blotted out."""
    return {k: redacted_config(v) if isinstance(v, dict) else "***" if SECRETS.search(k) else v for k, v in config.items()}


def load_config(path: str) -> dict:
    """A JSON (or, where a parser is installed, YAML) file."""
    text = Path(path).read_text()
    if path.endswith((".yaml", ".yml")):
        import yaml

        return yaml.safe_load(text) or {}
    return json.loads(text)


def keep_result(path: str, name: str, entry: dict) -> None:
    """Put one system's result into a result file, replacing its former one."""
    p = Path(path)
    had = json.loads(p.read_text()) if p.exists() else []
    p.write_text(json.dumps([*(e for e in had if e["system"] != name), entry | {"system": name}], indent=1))


def newest_result(folder: str, suffix: str = ".json") -> list[dict]:
    """The result file of the latest name in a folder."""
    files = sorted(Path(folder).glob(f"*{suffix}"))
    if not files:
        raise FileNotFoundError(f"no result file in {folder}")
    return json.loads(files[-1].read_text())


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="loomary")
    sub = parser.add_subparsers(dest="command", required=True)
    r = sub.add_parser("run", help="run the cases; exit code 1 if any failed")
    r.add_argument("--category", action="append", default=[])
    r.add_argument("--config", help="may name categories and the pass threshold")
    r.add_argument("--system", choices=("spark", "naive"), default="spark")
    r.add_argument("--json", help="result file")
    r.add_argument("--document", help="file for the whole run, case by case")
    s = sub.add_parser("show-config")
    s.add_argument("config")
    a = parser.parse_args(argv)
    if a.command == "show-config":
        print(json.dumps(redacted_config(load_config(a.config)), indent=1))
        return 0
    from pyspark.sql import functions as F

    from .evalsuite import runner
    from .operators import evaluate
    from .session import local_session

    config = load_config(a.config) if a.config else {}
    spark = local_session("loomary-eval", partitions=4)
    results = runner.run(spark, set(a.category or config.get("categories") or []) or None, runner.naive if a.system == "naive" else None)
    if "pass_threshold" in config:
        results = evaluate.judged(results.withColumn("pass_threshold", F.lit(float(config["pass_threshold"]))))
    print(runner.report(results))
    if a.json:
        keep_result(a.json, a.system, evaluate.overall(results).first().asDict() | {"categories": [x.asDict() for x in evaluate.category_scores(results).collect()]})
    if a.document:
        Path(a.document).write_text(json.dumps(runner.document(results, a.system, dt.datetime.now(dt.UTC).isoformat()), indent=1))
    return 1 if evaluate.failures(results).count() else 0


if __name__ == "__main__":
    raise SystemExit(main())
