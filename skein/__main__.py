"""python -m skein PATH status | vocabulary [--rebuild] | languages | configure key=value ..."""

from __future__ import annotations

import json
import sys

from pyspark.sql import SparkSession

from skein.functions.analyzer import LANGUAGES
from skein.plans.engine import Engine


def main(arguments: list[str]) -> int:
    if len(arguments) < 2:
        print(__doc__)
        return 2
    path, verb, *rest = arguments
    if verb == "languages":
        print("\n".join(LANGUAGES))
        return 0
    engine = Engine(SparkSession.builder.getOrCreate(), path)
    if verb == "status":
        print(json.dumps(engine.status(), indent=2))
    elif verb == "vocabulary":
        print(engine.rebuild_vocabulary() if "--rebuild" in rest else engine.store.table("words").count())
    elif verb == "configure":
        changed = engine.configure(dict(x.split("=", 1) for x in rest))
        print(json.dumps(engine.configuration() | {"reindex": changed}))
    else:
        print(__doc__)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
