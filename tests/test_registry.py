import re

from skein.plans import registry


def test_registry_names_and_keys():
    q, o = registry.queries(), registry.oracle_sql()
    assert set(o) <= set(q)
    for name in q:
        assert re.fullmatch(r"[a-z][a-z0-9_]*", name)
        assert "pipeline" not in name and not re.match(r"op\d+_", name)
    assert set(q) == set(o)
