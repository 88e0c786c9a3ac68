import base64
import json

import pytest

from demandlens import rules
from demandlens.operators import gap, market
from demandlens.sources import uploads

TEXT = "Java and spring boot for many years. " * 10


def line(**fields):
    return json.dumps({"cv_id": 1, "cv_name": "n", "file_name": "n.pdf", "modified_at": "2024-01-02T03:04:05Z", **fields})


def encoded(data):
    return base64.b64encode(data if isinstance(data, bytes) else data.encode()).decode()


GOOD = encoded(TEXT)
LINES = [
    (line(cv_id=1, content=GOOD), None),
    (line(cv_id=2, content=GOOD)[:-30], "record cannot be read"),
    ("not json at all", "record cannot be read"),
    (line(cv_id="three", content=GOOD), "record has no cv_id"),
    (line(cv_id=None, content=GOOD), "record has no cv_id"),
    (line(cv_id=5, content=GOOD + "!"), "content cannot be decoded"),
    (line(cv_id=6, modified_at="next week", content=GOOD), "time cannot be read"),
    (line(cv_id=7), None),
    (line(cv_id=8, content=encoded(TEXT.encode() + b"\xff\xfe ok")), None),
    (line(cv_id=9, content=GOOD, extra={"a": [1]}), None),
    (line(cv_id=10, content=encoded("short")), None),
    (line(cv_id=11, content=GOOD, file_name="n.docx"), None),
    (line(cv_id=12, content="%", file_name="n.docx"), "content cannot be decoded"),
    (line(cv_id=13, content=encoded(TEXT.replace("Java", "Kubernetes").replace("spring boot", "docker"))), None),
]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("uploads")
    for i in range(2):
        (path / f"part-{i}.json").write_text("\n".join(text for text, _ in LINES[i::2]) + "\n")
    return str(path)


def test_every_line_is_a_row_with_or_without_an_error(spark, folder):
    rows = uploads.read_uploads(spark, folder).collect()
    assert sorted(str(r.processing_error) for r in rows) == sorted(str(error) for _, error in LINES)
    by = {r.cv_id: r for r in rows if r.cv_id is not None}
    assert {i: by[i].processing_error for i in (1, 5, 6, 8, 12)} == {
        1: None, 5: "content cannot be decoded", 6: "time cannot be read", 8: None, 12: "content cannot be decoded",
    }
    assert by[1].cv_text == TEXT and by[8].cv_text == TEXT + " ok" and by[6].cv_text == TEXT and by[7].cv_text is None


REASONS = {
    1: None, 5: rules.REASON_FAILED, 6: rules.REASON_FAILED, 7: rules.REASON_UNREADABLE, 8: None, 9: None,
    10: rules.REASON_UNREADABLE, 11: rules.REASON_BAD_FILE, 12: rules.REASON_BAD_FILE, 13: rules.REASON_NO_JOBS,
}


def test_all_four_reasons_and_no_harm_to_others(spark, folder, make_jobs):
    slices = market.market_slices(make_jobs(("Backend Developer", "Mid", "Java, SQL", None, "Beta")))
    routed = gap.route(uploads.read_uploads(spark, folder), slices).collect()
    assert len(routed) == len(LINES)
    assert {r.cv_id: r.reject_reason for r in routed if r.cv_id is not None} == REASONS
    assert {r.reject_reason for r in routed if r.cv_id is None} == {rules.REASON_FAILED}
    alone = gap.route(uploads.read_uploads(spark, folder).filter("cv_id IN (1, 8, 9)"), slices).collect()
    accepted = [r for r in routed if r.status == gap.ACCEPTED]
    assert sorted(accepted, key=lambda r: r.cv_id) == sorted(alone, key=lambda r: r.cv_id) and len(alone) == 3
    assert {r.result.fit_score for r in accepted} == {50}
