"""Steps that only an outside program or a network can do. Off unless asked for."""

from __future__ import annotations

import shutil
import subprocess
import tempfile
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame

SCHEMA = "key string, returncode int, output string, error string"


class ToolMissing(RuntimeError):
    pass


def run_tool(inputs: DataFrame, command: Sequence[str], *, key: str, stdin: str, enabled: bool = False, timeout: int = 3600) -> DataFrame:
    """Feeds one row's text to the program and returns (key, returncode, output, error) for every row.

    A null text is empty input. The program must be installed on every executor.
    """
    if not enabled:
        raise ToolMissing(f"{command[0]} runs outside Spark; call with enabled=True where it is installed")
    command = list(command)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if shutil.which(command[0]) is None:
            raise ToolMissing(f"{command[0]} is not installed here")
        for pdf in batches:
            out = []
            for k, text in zip(pdf["key"], pdf["stdin"], strict=True):
                with tempfile.TemporaryDirectory() as work:
                    done = subprocess.run(command, input=text or "", capture_output=True, text=True, cwd=work, timeout=timeout, check=False)
                out.append((k, done.returncode, done.stdout, done.stderr))
            yield pd.DataFrame(out, columns=["key", "returncode", "output", "error"])

    return inputs.selectExpr(f"cast(`{key}` as string) as key", f"`{stdin}` as stdin").mapInPandas(run, SCHEMA)


def download(accession: str, kind: str) -> None:
    """Assemblies, read archives and reference databases come from the network, which this library does not use."""
    raise ToolMissing(f"{kind} {accession}: fetch it beforehand and register its path in the catalog")


def containers(spark, pointers: dict[str, str]) -> DataFrame:
    """(name, image) of pointer files that hold docker:// addresses."""
    rows = [(name, address.strip().removeprefix("docker://")) for name, address in sorted(pointers.items())]
    return spark.createDataFrame(rows, "name string, image string")
