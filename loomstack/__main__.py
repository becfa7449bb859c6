"""Command line: python -m loomstack ROOT index | query VERB FILE [FILE] | search TEXT | analyze NAME | export FORM"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from loomstack.api import Engine

VERBS = {"deps": "get_dependencies", "dependents": "get_dependents", "impact": "get_impact", "path": "get_path", "cycles": "get_cycles", "hubs": "get_hubs", "orphans": "get_orphans"}
ANALYSES = {"metrics": "get_metrics", "summary": "get_summary", "security": "get_security_issues", "secrets": "get_secrets", "duplication": "get_duplication", "rules": "check_rules", "dead-code": "get_dead_code", "narrator": "get_narrator_report"}


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="loomstack", description=__doc__)
    parser.add_argument("root")
    sub = parser.add_subparsers(dest="command", required=True)
    sub.add_parser("index")
    q = sub.add_parser("query")
    q.add_argument("verb", choices=VERBS)
    q.add_argument("files", nargs="*")
    s = sub.add_parser("search")
    s.add_argument("text")
    s.add_argument("--limit", type=int, default=20)
    sub.add_parser("analyze").add_argument("name", choices=ANALYSES)
    sub.add_parser("export").add_argument("form", choices=["json", "markdown", "html", "csv", "graphml"])
    a = parser.parse_args(args)
    engine = Engine(SparkSession.builder.appName("loomstack").getOrCreate()).index_project(a.root)
    if a.command == "export":
        print(engine.export(a.form))
        return
    if a.command == "index":
        found = engine.get_status()
    elif a.command == "query":
        found = getattr(engine, VERBS[a.verb])(*a.files)
    elif a.command == "search":
        found = engine.search(a.text, a.limit)
    else:
        found = getattr(engine, ANALYSES[a.name])()
    for name, df in found.items() if isinstance(found, dict) else [("", found)]:
        if name:
            print(name)
        df.show(50, truncate=60)


if __name__ == "__main__":
    main()
