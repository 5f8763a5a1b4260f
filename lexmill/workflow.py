"""Ordered steps that can be listed, checked, run and resumed; nested blocks, pools, processes and file steps."""

from __future__ import annotations

import argparse
import gzip as gz
import importlib
import os
import shutil
import subprocess
import tarfile
import urllib.request
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from itertools import islice
from pathlib import Path
from threading import Thread

import pandas as pd
from pyspark.sql import DataFrame


class StepFailed(RuntimeError):
    """A step returned a status other than 0, or a file that it needs is missing."""


@dataclass
class Step:
    name: str
    run: Callable[[], int | None]
    needs: list[str] = field(default_factory=list)
    makes: list[str] = field(default_factory=list)

    def check(self) -> None:
        missing = [p for p in self.needs if not Path(p).exists()]
        if missing:
            raise StepFailed(f"{self.name}: missing {', '.join(missing)}")

    def execute(self) -> None:
        self.check()
        status = self.run()
        if status:
            raise StepFailed(f"{self.name}: status {status}")


@dataclass
class Workflow:
    """Steps in order. A block is a workflow inside one; blocks nest, and a failure ends the run."""

    name: str = "workflow"
    steps: list[Step | Workflow] = field(default_factory=list)

    def add(self, step: Step | Workflow) -> Step | Workflow:
        self.steps.append(step)
        return step

    def step(self, name: str, needs: Sequence[str] = (), makes: Sequence[str] = ()) -> Callable:
        """Decorator that registers a function as a step."""
        return lambda f: self.add(Step(name, f, list(needs), list(makes))) and f

    def block(self, name: str) -> Workflow:
        return self.add(Workflow(name))

    def pool(self, threads: int, name: str, make: Callable[[int, Workflow], None]) -> Step:
        """``threads`` blocks that run at once; the first failure is raised when all have ended."""
        blocks = [Workflow(f"{name}.{i + 1}") for i in range(threads)]
        for i, block in enumerate(blocks):
            make(i + 1, block)

        def run() -> None:
            with ThreadPoolExecutor(threads) as pool:
                for done in [pool.submit(b.start) for b in blocks]:
                    done.result()

        return self.add(Step(name, run))

    def listing(self, prefix: str = "") -> Iterator[tuple[str, str]]:
        """(number, name) of all steps; those in blocks are numbered below theirs."""
        for i, step in enumerate(self.steps, 1):
            yield f"{prefix}{i}", step.name
            if isinstance(step, Workflow):
                yield from step.listing(f"{prefix}{i}.")

    def start(self, first: int = 1) -> None:
        """Runs from a step on; earlier ones are taken as done."""
        for step in self.steps[first - 1 :]:
            step.start() if isinstance(step, Workflow) else step.execute()

    def reset(self) -> None:
        self.steps.clear()


def do(*command: str, stdin: str | None = None, stdout: str | None = None, append: bool = False, stderr: str | None = None, env: dict | None = None, cwd: str | None = None) -> Step:
    """An external program as a step, with redirected streams; it must be on the PATH when the step is made."""
    if shutil.which(command[0]) is None:
        raise StepFailed(f"{command[0]}: not found")

    def run() -> int:
        with open(stdin or os.devnull, "rb") as i, open(stdout or os.devnull, "ab" if append else "wb") as o, open(stderr or os.devnull, "wb") as e:
            return subprocess.run(command, stdin=i, stdout=o, stderr=e, env={**os.environ, **(env or {})}, cwd=cwd, check=False).returncode

    return Step(" ".join(command), run, [stdin] if stdin else [], [stdout] if stdout else [])


def pipe(df: DataFrame, command: Sequence[str], column: str = "value") -> DataFrame:
    """Lines of a column through an external program, one process per task; what it prints are the new lines.

    A null is an empty line, and a value with line breaks is several lines. The program may end before it has read all.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        failures: list[Exception] = []
        with subprocess.Popen(list(command), stdin=subprocess.PIPE, stdout=subprocess.PIPE) as process:

            def feed() -> None:
                try:
                    with process.stdin as into:
                        for batch in batches:
                            into.write("".join(f"{x}\n" for x in batch[column].fillna("")).encode())
                except BrokenPipeError:
                    for _ in batches:
                        pass
                except Exception as failure:
                    failures.append(failure)

            writer = Thread(target=feed, daemon=True)
            writer.start()
            while part := list(islice(process.stdout, 10_000)):
                yield pd.DataFrame({column: [x.decode().removesuffix("\n") for x in part]})
            writer.join()
        if failures:
            raise failures[0]
        if process.returncode:
            raise StepFailed(f"{' '.join(command)}: status {process.returncode}")

    return df.select(column).mapInPandas(run, f"{column} string")


def mkdir(path: str, parents: bool = False) -> Step:
    return Step(f"mkdir {path}", lambda: Path(path).mkdir(parents=parents, exist_ok=True))


def rm(path: str, recursive: bool = False, if_exists: bool = False) -> Step:
    def run() -> int:
        if not Path(path).exists():
            return 0 if if_exists else 1
        shutil.rmtree(path) if recursive and Path(path).is_dir() else Path(path).unlink()
        return 0

    return Step(f"rm {path}", run)


def output(path: str) -> Step:
    """Fails unless the file is there once the steps before have run."""
    return Step(f"output {path}", lambda: 0 if Path(path).exists() else 1)


def check_exists(path: str) -> Step:
    return Step(f"check {path}", lambda: 0, [path])


def gzip(path: str) -> Step:
    def run() -> None:
        with open(path, "rb") as i, gz.open(f"{path}.gz", "wb") as o:
            shutil.copyfileobj(i, o)
        Path(path).unlink()

    return Step(f"gzip {path}", run, [path], [f"{path}.gz"])


def gunzip(path: str) -> Step:
    if not path.endswith(".gz"):
        raise StepFailed(f"{path}: not a .gz file")

    def run() -> None:
        with gz.open(path, "rb") as i, open(path[:-3], "wb") as o:
            shutil.copyfileobj(i, o)
        Path(path).unlink()

    return Step(f"gunzip {path}", run, [path], [path[:-3]])


def untar(path: str, into: str = ".") -> Step:
    def run() -> None:
        with tarfile.open(path) as tar:
            tar.extractall(into, filter="data")

    return Step(f"untar {path}", run, [path])


def fetch(url: str, path: str) -> Step:
    def run() -> None:
        with urllib.request.urlopen(url) as i, open(path, "wb") as o:
            shutil.copyfileobj(i, o, 4096)

    return Step(f"fetch {url}", run, [], [path])


def rewrite_config(lines: Sequence[str], suffixes: dict[str, str]) -> list[str]:
    """Lines with those that end in a key replaced by its value."""
    return [next((v for k, v in suffixes.items() if x.endswith(k)), x) for x in lines]


def decoder_config(root: str, language_model: str, order: int, scores: int = 5, reordering: int = 6, binary: bool = False, weights: Sequence[str] = ()) -> str:
    """A decoder's configuration; ``weights`` are the lines of a tuned one from its first weight section on."""
    table = f"{root}/phrase-table{'' if binary else '.gz'}"
    parts = [  # names and numbers of the format (fixed values)
        ("input-factors", ["0"]),
        ("mapping", ["0 T 0"]),
        ("ttable-file", [f"{1 if binary else 0} 0 0 {scores} {table}"]),
        ("lmodel-file", [f"{8 if binary else 0} 0 {order} {language_model}"]),
        ("ttable-limit", ["20"]),
        ("distortion-file", [f"0-0 wbe-msd-bidirectional-fe-allff {reordering} {root}/reordering-table{'' if binary else '.gz'}"]),
    ]
    if not weights:
        parts += [("weight-d", ["0.3"] * (reordering + 1)), ("weight-l", ["0.5"]), ("weight-t", ["0.2"] * scores), ("weight-w", ["-1"]), ("distortion-limit", ["6"])]
    text = "\n\n".join("\n".join([f"[{name}]", *rows]) for name, rows in parts)
    return "\n\n".join([text, "\n".join(weights)] if weights else [text]) + "\n"


def tuned_weights(lines: Sequence[str], header: str = "[weight-d]") -> list[str]:
    """The lines from the first one that equals ``header`` on."""
    at = next((i for i, x in enumerate(lines) if x == header), len(lines))
    return list(lines[at:])


def language_pair(a: str, b: str) -> tuple[str, str]:
    return min(a, b), max(a, b)


def groups(shards: int, workers: int) -> list[list[int]]:
    """Consecutive shards for each worker, what is left over spread on the first ones."""
    size, more = divmod(shards, workers)
    out, at = [], 0
    for i in range(workers):
        n = size + (i < more)
        out.append(list(range(at, at + n)))
        at += n
    return out


def main(args: Sequence[str] | None = None) -> None:
    """``python -m lexmill.workflow [-l] [-s STEP] MODULE [ARGS]``: MODULE has ``build(workflow, args)``."""
    parser = argparse.ArgumentParser(prog="lexmill")
    parser.add_argument("-s", "--from-step", type=int, default=1)
    parser.add_argument("-l", "--list", action="store_true")
    parser.add_argument("module")
    parser.add_argument("args", nargs=argparse.REMAINDER)
    chosen = parser.parse_args(args)
    flow = Workflow(chosen.module)
    importlib.import_module(chosen.module).build(flow, chosen.args)
    if chosen.list:
        for number, name in flow.listing():
            print(number, name)
    else:
        flow.start(chosen.from_step)


if __name__ == "__main__":
    main()
