"""The session all tests share."""

import os
import tempfile

from tradeweave.session import build_session

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def session():
    # Python workers import the package from here whatever folder the tests are started in
    os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [REPO, os.environ.get("PYTHONPATH")]))
    spark = build_session(
        "tradeweave-tests",
        spark__master="local[8]",
        spark__sql__shuffle__partitions="8",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="8g",
        spark__checkpoint__dir=tempfile.mkdtemp(prefix="tradeweave-tests-"),
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
