"""Origin of files by names: foreign styles, mangled names, remarks that are no declarations."""

from __future__ import annotations

import random

import pytest

from lakelens.llm import provenance as P

SCHEMA = "snapshot_id long, repo_id string, file_path string, content string"
WORDS = ["load", "merge", "score", "symbol", "chunk", "report", "branch", "quota", "state", "finding", "batch", "lease"]


def module(rng, join, n=40):
    out = []
    for _ in range(n):
        a, b, c = (rng.choice(WORDS) for _ in range(3))
        out.append(f"def {join(a, b)}({join(b, c)}):\n    {join(c, a)} = {join(b, c)} + {rng.randint(0, 999)}\n    return {join(c, a)}\n")
    return "\n".join(out)


def snake(a, b):
    return f"{a}_{b}"


def camel(a, b):
    return a + b.capitalize()


@pytest.mark.parametrize("remark", ["# Report generated by the nightly job is read here.\n", "# This module was taken from the billing library team notes.\n", "# Values produced by the scanner are merged below.\n", "# See the third-party guide.\n"])
def test_a_remark_alone_makes_no_case(remark):
    assert not any(P.judge("a.py", remark + module(random.Random(1), snake), {})[:4])


@pytest.mark.parametrize("head", ["# Code generated by x v1. DO NOT EDIT.\n", "# This file was automatically generated from api.yaml. Changes will be lost.\n", "# Diese Datei wurde automatisch erzeugt.\n", "# Produced by wirecompiler; manual edits are overwritten\n", "# @generated by x\n", "# source: a.proto (protoc-gen-x)\n"])
def test_declarations_are_enough(head):
    assert P.judge("a.py", head + module(random.Random(1), snake), {})[0]


def test_a_remark_counts_beside_template_names():
    body = "".join(f"def get_a(self):\n    return self.v['a{k}']\n" for k in range(12))
    assert P.judge("a.py", "# Getters generated by tooling are kept here.\n" + body, {})[0] and not P.judge("a.py", "# Getters are kept here.\n" + body, {})[0]


def test_foreign_naming_style_is_vendored(spark):
    rng = random.Random(2)
    rows = [(k, "r1", f"src/{k}.py", module(rng, snake)) for k in range(30)] + [(100, "r1", "src/grid.py", module(rng, camel)), (101, "r1", "src/tiny.py", module(rng, camel, 2)), (102, "r2", "src/own.py", module(rng, camel))]
    rows += [(200 + k, "r3", f"src/{k}.py", module(rng, camel)) for k in range(30)]
    got = {r.snapshot_id: (r.origin, r.foreign_names) for r in P.judged(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {k for k, v in got.items() if v[0]} == {100} and got[100] == ("vendored", True)


def test_mangled_names_are_told_by_cross_entropy(spark):
    rng = random.Random(3)
    plain = [(k, "r1", f"src/{k}.js", module(rng, camel).replace("def ", "function ").replace(":\n", " {\n").replace("\n\n", "\n}\n")) for k in range(20)]
    short = [rng.choice("abcdefghijkmnpqrtuvwxyz") + rng.choice("abcdexyz0123") for _ in range(200)]
    packed = ";".join(f"{rng.choice(short)}={rng.choice(short)}({rng.choice(short)},{rng.randint(0, 9)})" for _ in range(300))
    long_names = ";".join(f"{camel(rng.choice(WORDS), rng.choice(WORDS))}={camel(rng.choice(WORDS), rng.choice(WORDS))}({rng.randint(0, 9)})" for _ in range(300))
    rows = [*plain, (100, "r1", "dist/a.js", packed), (101, "r1", "src/table.js", long_names)]
    got = {r.snapshot_id: r.origin for r in P.judged(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {k for k, v in got.items() if v} == {100} and got[100] == "minified"


def test_nothing_stays_cached(spark):
    rows = [(k, None, f"{k}.py", module(random.Random(k), snake)) for k in range(3)]
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    P.unwritten_files(spark.createDataFrame(rows, SCHEMA)).collect()
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before
