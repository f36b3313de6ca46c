"""The prompt: reads statements up to a semicolon, shows results in a box and the time they took."""

from __future__ import annotations

import sys
import time
from collections.abc import Callable

from millrace.errors import EngineError
from millrace.printer import box


def loop(session, read: Callable[[str], str], write: Callable[[str], None]) -> None:
    """Run until quit, exit or the end of the input."""
    while True:
        text, prompt = "", "DB > "
        while not text.endswith(";") and not text.startswith("\\"):
            try:
                text += (" " if text else "") + read(prompt).strip()
            except EOFError:
                return
            prompt = ".. > "
        if text in ("quit;", "exit;"):
            write("Bye.")
            return
        start = time.perf_counter()
        try:
            names, rows = session.run(text)
            if names:
                write(box(names, rows))
        except EngineError as error:
            write(error.message)
        write(f"\nTime : {time.perf_counter() - start:.9f}s\n")


def main() -> None:
    try:
        import readline  # noqa: F401
    except ImportError:
        pass
    from pyspark.sql import SparkSession

    from millrace.session import Session

    spark = SparkSession.builder.appName("millrace").getOrCreate()
    root = sys.argv[1] if len(sys.argv) > 1 else spark.conf.get("spark.sql.warehouse.dir") + "/millrace"
    session = Session(spark, root.removeprefix("file:") if root.startswith("file:/") and not root.startswith("file://") else root)
    loop(session, input, print)


if __name__ == "__main__":
    main()
