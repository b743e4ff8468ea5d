import random
from dataclasses import replace

import pytest

from findgrain.llm import sentences as sn

LEX = sn.Lexicon()

CASES = {
    "titles": ["Mr. Foriyo vs. the helper of J. K. Badiweba Ltd. was our joke of the week.", "Dr. Bafo asked for approx. 66 folders, i.e. every one under the root."],
    "numbers": ["The score rose from .203 to 126.6, i.e. by a factor of 93.30.", "The draft shows only 691.", "If nothing is found, see Fig. 3, p. 8 and v1.2.md."],
    "quotes": ['"Is the index local?" asked Kifolo before the worker was locked.', '"I can\'t open it," said Hazace, "because it is locked."', "“Every backup is stale,” wrote Babazace.", 'Somuva replied: "Rebuild it first."', "Works again 🙂!"],
    "times": ["It stopped at 10:03 p.m.", "389 of the 850 helpers were rare.", "The merge ran from 1:00 a.m. to 7:54 p.m. and freed 70 GB."],
    "names": ["It keeps names, sizes, dates, etc.", ".tuhazarc is not part of the log.", "eDiscovery calls the index twice, e.g. for a.pdf.", "The U.S. team calls it a root."],
    "brackets": ["(The merge in a.log is older.)", "The worker (why not?) keeps a copy.", "The folder waits... then it drops the volume."],
    "german": ["Der Lauf vom 3. 30. dauerte bzw. hing i. d. R. 159,9 Sekunden.", "„Das war's!“", "„Ist er noch da?“, fragte Musofo kurz vor Schluss.", "Er wurde am 8. März neu aufgebaut, z. B. im 2. Abschnitt.", "Dort stehen Namen usw."],
    "french": ["« Où est le résumé ? » demanda Vafodi avant la fusion.", "Combien de fichiers, 486 ou 426 ?", "« Copiez-le ! » répéta Namuri.", "Il répondit : « Il faut d'abord copier. »", "Le fichier, le cache, etc. restent là."],
    "spanish": ["¿Y el archivo?", "¡¿Otra vez el índice?!", "Desde EE. UU. llegó el segmento núm. 555 de Yotuki.", "«¿Sigue vacío?», preguntó Bafo en voz baja.", "Vakiba contestó: «Primero copia el registro».", "La Dra. Riloha (tel. ext. 635) abrirá a.md a las 10:51 h."],
    "russian": ["Поиск нашёл модуль, файл и т. д.", "См. рис. 40 и стр. 714 в файле a.md.", "«Где файл?» — спросил Rikipe перед слиянием.", "В 465 г. список занимал 82,74 ГБ, т. е. около 549 тыс. файлов.", "И. О. Baceyolo проверил файл."],
    "arabic": ["راجع ص. 192 من الملخص.", "هل الفهرس فارغ مرة أخرى؟!", "وصل د. Babacefo في الساعة 8:13.", "توقف الملف... ثم عاد."],
    "hindi": ["क्या कतार पुरानी है?!", "“क्या सारांश खुली है?” Kibana ने पूछा।", "Kicegu ने लिखा: “पहले मसौदा सहेजें।”", "डॉ. Peloza ने पृ. 42 देखी।"],
}


@pytest.mark.parametrize("name", CASES)
def test_spaced_scripts(name):
    for seed in range(3):
        parts = CASES[name][:]
        random.Random(seed).shuffle(parts)
        text = " ".join(parts)
        assert [text[a:b] for a, b in sn.split_text(text, LEX)] == parts


def test_scripts_without_blanks():
    zh = ["请不要删除a.final.rs！", "他说：“先备份排序。”", "“先别动。等卷合并完。”他写道。", "No. 405的分段属于Dr. Foriyo。", "标签等……但不含队列。", "（另见a.toml。）", "约54个文件……", "难道路径又空了？！"]
    ja = ["「候補はまだありますか？」と担当者が尋ねた。", "担当者は「先に保存して。」と書いた。", "約703件ある……", "Dr. Haceyoが開いた。", "名前などがある……しかし待ち行列はない。"]
    for parts in (zh, ja):
        text = "".join(parts)
        assert [text[a:b] for a, b in sn.split_text(text, LEX)] == parts
    th = ["เมื่อเวลา 12:05 น. ระบบพบสรุปช้า", "ใครเป็นคนลบไฟล์ไปเมื่อวาน?", "กรุณาอย่าลบ a.tar.gz ออกจากโฟลเดอร์", "ทีมงานส่งร่าง 27 ฉบับให้ Rimutu ตรวจ", "อย่าปิดคลังตอนนี้!"]
    text = " ".join(th)
    assert [text[a:b] for a, b in sn.split_text(text, LEX)] == th


def test_blocks():
    text = "# Open points\n\n- rebuild the scan. Now (7)\n* keep v4.4\n \n42. Merge notes\r\n\r\nOne line\nbreak. Two.Three ends\n\n\n  Q & A  "
    assert [text[a:b] for a, b in sn.split_text(text, LEX)] == ["# Open points", "- rebuild the scan. Now (7)", "* keep v4.4", "42. Merge notes", "One line\nbreak.", "Two.", "Three ends", "Q & A"]


def test_document_evidence_decides_unknown_words():
    text = "The qrx. of it is big, see qrx. 7 and the Vexor there. Then qrx. Vexor came."
    assert [text[a:b] for a, b in sn.split_text(text, LEX)] == ["The qrx. of it is big, see qrx. 7 and the Vexor there.", "Then qrx. Vexor came."]
    text = "It has a qrx. Vexor came."
    assert len(sn.split_text(text, LEX)) == 2


def test_document_evidence_has_no_length_limit():
    for word in ("proceedngs", "x" * 200):
        text = f"The {word}. of it is big, see {word}. 7 there and {word}. Vexor with Vexor in it. Then it ends."
        assert [text[a:b] for a, b in sn.split_text(text, LEX)][-1] == "Then it ends." and len(sn.split_text(text, LEX)) == 2


def test_corpus_evidence():
    rows = [("foo", 100, 60, 20, 10, 0), ("end", 100, 0, 0, 70, 30), ("etc", 90, 30, 0, 30, 30), ("#am", 50, 0, 10, 40, 0), ("#vol", 60, 0, 5, 40, 15), ("rare", 29, 29, 0, 0, 0)]
    lex = sn.learn(rows)
    assert "foo" in lex.never_final and "end" in lex.ordinary and "etc" in lex.may_end and lex.ordinal("am") and "vol" in lex.not_ordinals
    assert lex.of("rare") is None and lex.of("etc") == sn.MAY and lex.of("Mr") == sn.NEVER
    # the corpus overrules the seeds, which are asked only where it has nothing
    lex = sn.learn([("no", 100, 0, 0, 70, 30), ("#am", 60, 0, 5, 40, 15)])
    assert lex.of("no") == sn.ORDINARY and not lex.ordinal("am") and lex.ordinal("vom")


def test_without_seeds_the_corpus_shows_the_abbreviations():
    """A corpus of the cases in other orders, as paragraphs, in place of the seed list."""
    none = (frozenset(),) * 3
    counts = sn.Counter()
    for seed in range(60):
        for parts in CASES.values():
            parts = parts[:]
            random.Random(seed).shuffle(parts)
            counts += sn.gather([" ".join(parts[:2]) + "\n\n" + " ".join(parts[2:])])
    rows: dict = {}
    for (key, kind), n in counts.items():
        r = rows.setdefault(key, dict.fromkeys("nldUE", 0))
        r["n"] += n
        r[kind if kind in "ldUE" else "n"] += n if kind in "ldUE" else 0
    lex = replace(sn.learn((k, r["n"], r["l"], r["d"], r["U"], r["E"]) for k, r in rows.items()), seeds=none)
    right = whole = 0
    for parts in CASES.values():
        text = " ".join(parts)
        got = {text[a:b] for a, b in sn.split_text(text, lex)}
        right += len(got & set(parts))
        whole += len(parts)
    assert right >= 0.9 * whole, (right, whole)


@pytest.mark.parametrize("text", ["", " ", "\n\n", "...", "?!", "“", '"', "»", ".", "a", "x" * 100_000, '"a. B. ' * 20_000, "“Abc def. " * 20_000, "a.\n" * 50_000, "　。"])
def test_odd_texts(text):
    spans = sn.split_text(text, LEX)
    assert all(0 <= a < b <= len(text) and not text[a].isspace() and not text[b - 1].isspace() for a, b in spans)
    assert all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))
    covered = "".join(text[a:b] for a, b in spans)
    assert "".join(covered.split()) == "".join(text.split())


def test_table(spark):
    rows = [(1, "One. Two.", "x"), (2, None, "x"), (3, "", "x"), (4, "  ", "x"), (None, "One.", "x"), (5, "🙂 Ok. 🙂", "x"), (5, "🙂 Ok. 🙂", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, start_char string")
    got = sorted(map(tuple, sn.sentences(df).collect()))
    assert got == [(1, 0, 4), (1, 5, 9), (5, 0, 5), (5, 0, 5), (5, 6, 7), (5, 6, 7)]
    assert sn.sentences(df.limit(0)).count() == 0


def test_document_evidence_overrules_lexicon_and_seeds():
    text = "There is no index and no cache. He said no. Then he left."
    assert [text[a:b] for a, b in sn.split_text(text, LEX)] == ["There is no index and no cache.", "He said no.", "Then he left."]
    # also where the corpus holds the word for an abbreviation, at any length
    lex = sn.Lexicon(never_final=frozenset(["no", "backup"]), ordinary=frozenset(["segment"]))
    text = "A backup is old. It needs a backup. Then it ends."
    assert len(sn.split_text(text, lex)) == 3
    # shown as an abbreviation here though ordinary in the corpus
    text = "The segment. of it, see the segment. in it. All is well."
    assert [text[a:b] for a, b in sn.split_text(text, lex)] == ["The segment. of it, see the segment. in it.", "All is well."]
    # without evidence, or with evidence both ways, the lexicon decides
    assert len(sn.split_text("He said no. Then he left.", LEX)) == 1
    assert len(sn.split_text("There is no index, see no. of it. He has no. Then he left.", LEX)) == 2
    # a word before a capital or a digit may be an abbreviation without its point, and a digit goes on
    assert len(sn.split_text("We saw Dr Bafo and Fig 3. Then Dr. Bafo left Fig. 3 there.", LEX)) == 2
