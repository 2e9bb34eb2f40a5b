"""Letters of keywords count in either case in A-Z, and no letter outside ASCII stands for one."""

import pytest

from pulseframe.llm import secrets

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
HEX = "0123456789abcdef0123456789abcdef"


@pytest.mark.parametrize("text, assign", [
    ("toKen=abcdefgh", 0), ("toKen=abcdefgh " + HEX, 0), ("paſſword=abcdefgh " + HEX, 0), ("ſecret: abcdefgh", 0),
    ("toKen=abcdefgh " + HEX, 1), ("PassWord: 'abcdefgh' SECRET=12345", 1), ("Api_Key=abcdef APIKEY=abcdef", 2),
])
def test_letters(spark, text, assign):
    row = secrets.find_secrets(spark.createDataFrame([(1, text, "en", "s", 1)], SCHEMA)).first()
    assert (row.n_assign, row.n_hex) == (assign, int(HEX in text))
