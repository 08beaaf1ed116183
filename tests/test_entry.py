"""The entry module without its optional parts."""

import builtins

import pytest

import __spark_entry__ as entry


@pytest.mark.parametrize("missing", ["pairlab.llm", "corpus_pipeline", "public_tokenizers", "xxhash"])
def test_a_missing_part_leaves_the_other_queries(monkeypatch, missing):
    import sys

    real = builtins.__import__

    def without(name, *args, **kwargs):
        if name == missing or name.startswith(f"{missing}."):
            raise ModuleNotFoundError(f"No module named {missing!r}", name=missing)
        return real(name, *args, **kwargs)

    for name in [n for n in sys.modules if n.startswith("pairlab.llm") or n == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setattr(builtins, "__import__", without)
    names = entry.queries()
    assert {"segment_accuracy", "fit_general", "boosted_stump"} <= set(names) and "pipeline" not in names
    assert set(entry.oracle_sql()) <= set(names)
