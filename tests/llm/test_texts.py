"""Garbled text by exact round trips, personal data by accuracy on texts of another hand and exact places."""

import math
import random

import pytest

from quarryline.llm import mojibake as M
from quarryline.llm import pii, train_pii
from tests.llm.plain_texts import marked

TEXTS = [
    ("Die Größe wäre für uns natürlich größer, aber die Prüfung schlägt fehl. Könnten wir später prüfen?", ["utf_8>cp1252", "utf_8>latin_1", "utf_8>cp437", "utf_8>mac_roman", "utf_8>cp1252 twice", "utf_8>cp1251", "utf_8>cp850", "cp1252>mac_roman", "cp1252>cp1251", "cp437>cp1252"]),
    ("Après la mise à jour, la réponse a été tronquée ; c’est gênant pour l’équipe, déjà relevé deux fois.", ["utf_8>cp1252", "utf_8>mac_roman", "utf_8>cp437"]),
    ("Спасибо, тест наконец прошёл. Похоже, что граф памяти читает данные дважды.", ["utf_8>cp1252", "utf_8>latin_1", "koi8_r>cp1251", "cp1251>koi8_r", "cp1251>cp1252", "utf_8>cp1251"]),
    ("テストを追加して、もう一度確認してください。再起動すると直りますが、原因はまだ不明です。", ["utf_8>cp1252", "shift_jis>cp1252", "euc_jp>cp1252"]),
    ("日志里出现了提示。重启以后可以恢复，但是原因还不清楚。谢谢，现在一切正常。", ["utf_8>latin_1", "utf_8>cp1252"]),
]
CLEAN = ["Plain ASCII only.", "", None, "5 µs per row — that’s “fine” … ok → done", "Größe 5 °C, naïve façade, ¿Por qué? ¡Funciona!", "│   merge_graph … ok\n└── src/rows.md", "Reader wrote `jalapeÃ±o` for it.", "The mark `�` is counted 2 times, not", "Ошибка «index out of date» появляется — 5 секунд.", "x" * 50_000]


@pytest.mark.parametrize("text,state", [(t, s) for t, states in TEXTS for s in states])
def test_damage_is_found_and_undone(text, state):
    broken = M.damage(text, state)
    found = M.examine(broken)
    assert found is not None and M.model().suspicious([broken])[0]
    if "�" not in broken and state not in ("cp437>cp1252", "utf_8>cp1251", "cp1252>cp1251"):
        assert found[1] == text


def test_part_of_a_long_text():
    clean = "All good here. " * 3000
    broken = clean + M.damage("Größe überprüfen", "utf_8>cp1252") + clean
    assert M.examine(broken)[1] == clean + "Größe überprüfen" + clean


@pytest.mark.parametrize("text", CLEAN)
def test_clean(text):
    assert M.examine(text) is None


def test_lost_characters():
    spans, restored, lost = M.examine("a na�ve fix")
    assert lost and restored is None


def test_spans_are_restored_one_by_one():
    text = M.damage("Größe überprüfen", "utf_8>cp1252") + " and a na�ve fix, plain words between them. " + M.damage("Спасибо, тест прошёл", "cp1251>cp1252")
    _, restored, lost = M.examine(text)
    assert lost and restored.startswith("Größe überprüfen and a na�ve fix") and restored.endswith("Спасибо, тест прошёл")


def test_damaged_frame(spark):
    rows = [(i, t, 1) for i, t in enumerate([*CLEAN, M.damage(TEXTS[0][0], "utf_8>cp1252")])]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans int")
    assert [(r["doc_id"], r["restored"]) for r in M.damaged(df).collect()] == [(len(CLEAN), TEXTS[0][0])]
    assert M.damaged(df.limit(0)).count() == 0


def test_accuracy_on_sentences_of_another_hand():
    figures = train_pii.evaluate(pii.model(), marked())
    for kind, (precision, recall, _) in figures.items():
        assert precision >= (0.85 if kind == "person_name" else 0.99) and recall >= (0.8 if kind == "person_name" else 0.99), (kind, precision, recall)


def test_accuracy_on_generated_sentences():
    train_pii.r.seed(20260)
    plain = ["All clear here, nothing to report.", "Returns the number of bytes written so far."]
    for kind, (precision, recall, _) in train_pii.evaluate(pii.model(), [train_pii.sentence(plain) for _ in range(800)]).items():
        assert precision > 0.96 and recall > 0.94, (kind, precision, recall)


def test_forward_and_backward_against_all_labellings():
    r = random.Random(3)
    line = pii.Line("Ask Ana Ruiz, 12 Elm Road, 555-010-9999 or ana@x.org")
    lattice = pii.Lattice(line, frozenset(["ask", "or"]), frozenset())
    n = len(lattice.segments)
    score = [r.uniform(-2, 2) for _ in range(n)]
    step = [[r.uniform(-1, 1) for _ in near] for near in lattice.near]

    def chains(k):
        """Score and segments of every labelling whose last segment is k."""
        yield score[k], [k]
        for j in range(n):
            between = lattice.segments[k][0] - lattice.segments[j][1]
            if between >= 0:
                move = next((s for (i, _), s in zip(lattice.near[k], step[k], strict=True) if i == j), 0.0)
                for s, chain in chains(j):
                    yield s + move + score[k], [*chain, k]

    all_of = [(0.0, []), *(c for k in range(n) for c in chains(k))]
    z = sum(math.exp(s) for s, _ in all_of)
    ending, upto = pii.forward(lattice, score, step)
    assert n > 8 and abs(upto[-1] - math.log(z)) < 1e-9
    of_segment, _ = pii.backward(lattice, score, step, ending, upto)
    for k in range(n):
        assert abs(of_segment[k] - sum(math.exp(s) for s, c in all_of if k in c) / z) < 1e-9
    assert pii.best_segments(lattice, score, step) == max(all_of)[1]


def test_mentions_and_their_places():
    text = "ok\nInvoice goes to Jorik A. Tarnmoor, 23 Fengate Court, Apt 4, 90210 Dunhollow.\nmy number is +1 306 555 0151, ping me after Grace period\nnote SSN 990-12-1517"
    found = [(k, text[a:b]) for a, b, k in pii.mentions(text)]
    assert found == [("person_name", "Jorik A. Tarnmoor"), ("street_address", "23 Fengate Court, Apt 4, 90210 Dunhollow"), ("phone", "+1 306 555 0151"), ("identity_number", "990-12-1517")]
    assert pii.redact(text, pii.mentions(text)) == "ok\nInvoice goes to [PERSON_NAME], [STREET_ADDRESS].\nmy number is [PHONE], ping me after Grace period\nnote SSN [IDENTITY_NUMBER]"


@pytest.mark.parametrize("text", [None, "", " ", "\n\n", "Updated git@git.invalid:ember/tools-396.git and reran the suite; all green.", "The diff in Rose theme is small: one guard and a test.", "Bumped the limit from 4096 to 16384 tokens in buffer of 7497790760 bytes.", "Moved the retry into line 879 of Street.tsx."])
def test_no_mentions(text):
    assert pii.mentions(text) == []


def test_frames(spark):
    rows = [(1, "Signed off: Vilena Aldmoor", ["read x", None, "note SSN 990-12-1517"], 5), (2, None, None, 5), (3, "", [], None), (1, "Signed off: Vilena Aldmoor", None, 5)]
    df = spark.createDataFrame(rows, "message_id long, content string, tool_calls array<string>, start_char int")
    found = sorted(map(tuple, pii.find(df).drop("end_char").collect()))
    assert found == [(1, "content", -1, 12, "person_name"), (1, "content", -1, 12, "person_name"), (1, "tool_calls", 2, 9, "identity_number")]
    out = {r["message_id"]: r for r in pii.redacted(df.limit(3)).collect()}
    assert out[1]["tool_calls"] == ["read x", None, "note SSN [IDENTITY_NUMBER]"] and out[2]["tool_calls"] is None and out[3]["tool_calls"] == []
