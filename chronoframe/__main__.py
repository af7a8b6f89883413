"""``python -m chronoframe BASE "STATEMENT" ...``, or ``python -m chronoframe BASE --serve PORT``."""

import sys

from .api import Engine
from .server import serve
from .session import session


def main(args: list[str]) -> int:
    if len(args) < 2:
        print(__doc__, file=sys.stderr)
        return 2
    engine = Engine(session(), args[0])
    if args[1] == "--serve":
        serve(engine, int(args[2]) if len(args) > 2 else 8086).serve_forever()
    for text in args[1:]:
        engine.query(text).show(1000, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
