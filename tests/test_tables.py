"""Hand-written tables: labels beside and above, grids, titles, questions, gaps and crossed cells."""

from dataclasses import asdict, replace

from quillgrid.plans import tables as T


def slots(rows):
    return {(r, c): (display, index, group) for r, c, _, _, display, index, group in T.Table(T.cells_by_text(rows)).slots(1)}


def test_labels_to_the_left():
    assert slots([["성명", "", "주소", "", ""]]) == {(0, 1): (["성명"], 1, None), (0, 3): (["주소"], 1, None), (0, 4): (["주소"], 2, None)}
    assert slots([["신청인", "성명", ""]]) == {(0, 2): (["신청인", "성명"], 1, None)}


def test_header_over_repeated_rows():
    got = slots([["성명", "관계"], ["", ""], ["", ""]])
    assert got[1, 0] == (["성명"], 1, None) and got[2, 1] == (["관계"], 2, None)


def test_grid():
    got = slots([["구분", "2023", "금액", "비고란"], ["수입", "", "", ""], ["지출", "", "", ""]])
    assert got[2, 2] == (["지출", "금액"], 1, None) and got[1, 3] == (["수입", "비고란"], 1, None)


def test_titles_and_questions():
    got = slots([["□ 경력 사항 : 관련 경력", ">"], ["기관", ""], ["※ 참고", ">"], ["부서", ""]])
    assert got == {(1, 1): (["기관"], 1, "경력 사항"), (3, 1): (["부서"], 1, "경력 사항")}
    question = "이 사업에 지원하게 된 동기와 앞으로의 계획을 자세히 적어 주시기 바랍니다. 분량은 자유입니다."
    got = slots([["가", "나", "다"], [question, "①", "②"], ["", "③", "④"]])
    assert got[2, 0] == ([question[:40] + "…"], 1, None)


def test_crossed_and_gap_rows():
    cells = [T.Cell(0, 0, 1, 2, "앞"), T.Cell(1, 0, height=300, left=None, right=None), T.Cell(1, 1, height=300, left=None, right=None), T.Cell(2, 0, 1, 1, "성명"), T.Cell(2, 1, crossed=True)]
    assert T.Table(cells).slots(1) == []
    tall = [replace(c, height=1000) if c.row == 1 else c for c in cells]  # right under a full-width heading
    assert [s[:2] for s in T.Table(tall).slots(1)] == [(1, 0), (1, 1)]


def test_spark(spark):
    rows = [{"form_id": f, "t": 1, **asdict(c)} for f in ("a", "b") for c in T.cells_by_text([["성 명", "", ""], ["성명", "", "주소"]])]
    cells = spark.createDataFrame(rows, "form_id string, t int, row int, col int, row_span int, col_span int, text string, height int, fields int, controls int, outside string, left string, right string, top string, bottom string, crossed boolean")
    got = T.with_keys(T.table_slots(cells)).where("form_id = 'b'").orderBy("row", "col").collect()
    assert [(r.id, r.key) for r in got] == [("t1.r0c1", "성명@1"), ("t1.r0c2", "성명#2"), ("t1.r1c1", "성명@2")]
