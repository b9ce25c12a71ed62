"""The usage example in README.md runs as written (sf0.001 tables)."""

import os
import re

README = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "README.md")


def test_readme_example_runs(spark, capsys):
    text = open(README).read()
    section = text[text.index("## Using the library"):]
    code = re.search(r"```python\n(.*?)```", section, re.S).group(1)
    scope = {}
    exec(compile(code, "README.md", "exec"), scope)
    best = scope["H"].best_epoch(scope["acc"], by=["model_id"]).collect()
    assert len(best) == len(scope["models"])
    assert all(0.0 <= r["best_acc"] <= 1.0 for r in best)
