"""Passwords in URLs of any length are found and redacted."""

import pytest

from quillgrid.llm import secrets


@pytest.mark.parametrize("size", [3, 64, 65, 5000])
def test_long_logins(spark, size):
    text = "see https://" + "u" * size + ":" + "Zq" * size + "@host/x now"
    docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    assert [(s.kind, s.start, s.end) for s in secrets.scan(docs).first().spans] == [("url_login", 4, text.index("@") + 1)]
    assert secrets.redact(docs).first().text == "see [URL_LOGIN]host/x now"
