"""Driver actions of this subpackage: each with the bound that makes it one."""

import ast
import os

ROOT = os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "terminus", "llm")

# (module, function): what comes to the driver, and why it is bounded
ALLOWED = {
    ("language_id", "fit"): "one row per language; vocabulary x languages numbers",
    ("licenses", "scan"): "terms in more than one of 1,000 texts: at most 1,000 x the mean number of distinct terms of a text",
    ("token_counts", "frequent_lengths"): "the ``size`` most frequent pre-tokens (merged from as many per partition)",
    ("packing", "pack"): "one row per rest length below the window",
    ("fingerprints", "compare_neighbours"): "one row per 32 MB of text: not bounded, but 3 million times smaller than the texts",
    ("lexical_search", "search"): "the (item, term) rows of a block: BLOCK_TERMS and one item more",
    ("lexical_search", "_block"): "one row per term of the block",
}


def actions():
    for name in sorted(os.listdir(ROOT)):
        if name.endswith(".py"):
            tree = ast.parse(open(os.path.join(ROOT, name)).read())
            for top in tree.body:
                for node in ast.walk(top):
                    if isinstance(node, ast.Call) and isinstance(node.func, ast.Attribute) and node.func.attr in (
                            "collect", "toPandas", "toLocalIterator", "localCheckpoint") and getattr(node.func.value, "id", "") != "gc":
                        yield name[:-3], getattr(top, "name", "")


def test_every_driver_action_is_listed_with_its_bound():
    assert set(actions()) == set(ALLOWED)


def test_nothing_else_imports_this_subpackage():
    for base, dirs, files in os.walk(os.path.dirname(ROOT)):
        dirs[:] = [d for d in dirs if d != "llm"]
        for f in files:
            if f.endswith(".py"):
                assert "terminus.llm" not in open(os.path.join(base, f)).read(), f
