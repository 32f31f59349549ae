import re
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_docstrings_name_nothing_that_is_left_out():
    left = (ROOT / "README.md").read_text().partition("## Left out")[2]
    ids = set(re.findall(r"\b[A-Z]{2}-\d+\b", left))
    found = {(p.name, i) for p in (ROOT / "docloom").rglob("*.py") for i in re.findall(r"\b[A-Z]{2}-\d+\b", p.read_text()) if i in ids}
    assert not found
