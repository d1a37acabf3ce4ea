import pytest

from gleanspark.llm.sentences import sentences, starts

CASES = {
    "Dr. Who read p. 3. It rained. The U.S. mirror lags, e.g. by 3.5 s.": ["Dr. Who read p. 3.", "It rained.", "The U.S. mirror lags, e.g. by 3.5 s."],
    "“Who did it?” asked Ann. “We cut. We stay,” she said. He noted (twice!) that it rained.": ["“Who did it?” asked Ann.", "“We cut. We stay,” she said.", "He noted (twice!) that it rained."],
    "It ended. (See sec. 2.) Next one.": ["It ended.", "(See sec. 2.)", "Next one."],
    "At approx. 7 a.m. Lomi answered. It was used by 5 p.m. What now?": ["At approx. 7 a.m. Lomi answered.", "It was used by 5 p.m.", "What now?"],
    "Wait ... the diff shows none. a.txt is empty. iFetch reads it.Then it ends.": ["Wait ... the diff shows none.", "a.txt is empty.", "iFetch reads it.", "Then it ends."],
    "Am 3. Mai kam Hr. Dr. Lom. „Fertig? Ja“, rief er z. B. laut. Gut!": ["Am 3. Mai kam Hr. Dr. Lom.", "„Fertig? Ja“, rief er z. B. laut.", "Gut!"],
    "« Fini\xa0? » demanda Lom. Attention ! Lom dit : « Non\xa0! » Oui.": ["« Fini\xa0? » demanda Lom.", "Attention !", "Lom dit : « Non\xa0! »", "Oui."],
    "«Готово?» — спросил он. Меню и т. д. удаляются. Конец!": ["«Готово?» — спросил он.", "Меню и т. д. удаляются.", "Конец!"],
    "Τι άλλαξε; Είπε ο κ. Βελ.": ["Τι άλλαξε;", "Είπε ο κ. Βελ."],
    "كم سطرا؟ قال د. فلتين نعم. انتهى!": ["كم سطرا؟", "قال د. فلتين نعم.", "انتهى!"],
    "क्या तैयार है? डॉ. वेल ने जाँच की। “रुकिए। कल,” उसने कहा।": ["क्या तैयार है?", "डॉ. वेल ने जाँच की।", "“रुकिए। कल,” उसने कहा।"],
    "他问：“完成了吗？”请等。“停下。不行。”工程师说。菜单……但标题还在。（详见第3节。）": ["他问：“完成了吗？”", "请等。", "“停下。不行。”工程师说。", "菜单……但标题还在。", "（详见第3节。）"],
    "「止めましょう。」と言いました。約3件（第1章を参照。）が残りました。本当ですか!?はい。": ["「止めましょう。」と言いました。", "約3件（第1章を参照。）が残りました。", "本当ですか!?", "はい。"],
    "อย่าลบสำเนา ไฟล์ a.txt ว่าง 7 หน้า": ["อย่าลบสำเนา", "ไฟล์ a.txt ว่าง 7 หน้า"],
    "# Head 1. x\nFirst line\nwrapped. Two\n- item one\n1. item. More\n\nlast": ["# Head 1. x", "First line\nwrapped.", "Two", "- item one", "1. item.", "More", "last"],
}


@pytest.mark.parametrize("text", CASES)
def test_cases(text):
    at = starts(text)
    assert [text[p : (at + [len(text)])[k + 1]].rstrip() for k, p in enumerate(at)] == CASES[text]


def test_round_trip_and_edges(spark):
    rows = [(k, t, k) for k, t in enumerate([*CASES, None, "", " \n ", "🚀 a. B.", "no end " * 5000, "“" * 50 + ". A"])]
    got = {}
    for r in sentences(spark.createDataFrame(rows, "doc_id bigint, text string, sent_no bigint")).orderBy("doc_id", "sent_no").collect():
        got.setdefault(r.doc_id, []).append(r)
    for k, t, _ in rows:
        if t and t.strip():
            assert "".join("".join(r.sentence.split()) for r in got[k]) == "".join(t.split())
            assert all(t[r.start_pos] == r.sentence[0] for r in got[k])
        else:
            assert k not in got
