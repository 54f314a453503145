"""Command line: python -m cairn.cli FOLDER ACTION [name=value …]"""
from __future__ import annotations

import json
import sys

from cairn.plans.api import Tools, Vault
from cairn.session import session
from cairn.sources.notes import read_notes


def value(text: str):
    try:
        return json.loads(text)
    except json.JSONDecodeError:
        return text


def main(args: list[str]) -> int:
    if len(args) < 2:
        print(__doc__)
        return 2
    spark = session("cairn-cli")
    tools = Tools(Vault(spark, read_notes(spark, args[0])))
    if args[1] == "tools":
        print("\n".join(f"{n}{s}" for n, s in tools.describe().items()))
        return 0
    out = tools.call(args[1], **{k: value(v) for k, _, v in (a.partition("=") for a in args[2:])})
    if hasattr(out, "toJSON"):
        for row in out.collect():
            print(json.dumps(row.asDict(True), default=str, ensure_ascii=False))
    else:
        print(out)
    return int(isinstance(out, str) and out.startswith("Error:"))


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
