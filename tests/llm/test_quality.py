from __future__ import annotations

import base64
import math
import random
import re
from collections import Counter

import sentencepiece
import tiktoken
from bulwark.llm import quality
from bulwark.llm.common import tokenizer_path


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    inside = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    failed = len(words) < 50 or 100 * len(inside) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside), failed


def test_base_counts(docs, edge_rows):
    rng = random.Random(4)
    rows = list(edge_rows) + [(100 + k, "".join(rng.choice(["a ", "b ", "c\n", "é#", " ", "|x ", "\n"]) for _ in range(rng.randint(0, 200))), "en", "s") for k in range(200)]
    rows += [(400, "a a a a", "en", "s"), (401, "x y z x y z", "en", "s"), (402, "\n\nq\nq\n q\nq", "en", "s")]
    got = quality.quality_rules(docs(rows)).collect()
    want = sorted(str((i, *brute(t))) for i, t, _, _ in rows)
    assert sorted(str((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)) for r in got) == want
    assert not any(r.kept and r.base_failed for r in got)


def prose(seed, n=200):
    rng = random.Random(seed)
    words = "the of and to in that with from this have which their about people water after during between small house garden morning river people light".split()
    return " ".join(rng.choice(words) + ("." if rng.random() < 0.1 else "") for _ in range(n))


def test_fertility_rejects_bytes_and_symbols(docs):
    rows = [(1, prose(1), "en", "s"), (2, prose(2, 60), None, "s"), (3, " ".join(chr(0x1F600 + k % 70) * 3 + str(k) for k in range(80)), "en", "s"), (4, " ".join(f"{w}$%&***" for w in prose(3, 400).split()), "en", "s")]
    got = {r.doc_id: r for r in quality.quality_rules(docs(rows)).collect()}
    assert got[1].kept and got[2].kept and not got[3].kept
    assert got[3].byte_share > 0.2 and got[1].byte_share == 0
    assert got[4].chars_per_token < got[1].chars_per_token


def test_stage_keeps_columns(docs, edge_rows):
    df = docs([*edge_rows, (50, prose(5), "en", "s")])
    out = quality.keep_good(df)
    assert out.columns == df.columns
    rows = out.collect()
    assert [r.doc_id for r in rows] == [50] and rows[0].size == -1 and rows[0].text == prose(5)
    assert quality.keep_good(docs([])).count() == 0


def fertility_by_hand(text):
    """Tokens, code points per token, byte share and entropy under both vocabularies, word by word."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    with open(tokenizer_path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    multi = tiktoken.Encoding("x", pat_str=quality.SPLIT, mergeable_ranks=ranks, special_tokens={})
    first, second = [i for w in words for i in model.encode(w)], [i for w in words for i in multi.encode_ordinary(" " + w)]
    byte = [sum(map(model.is_byte, first)), 0]
    for i in second:
        try:
            multi.decode_single_token_bytes(i).decode()
        except UnicodeDecodeError:
            byte[1] += 1
    out = []
    for ids, cut in zip((first, second), byte, strict=True):
        n = max(len(ids), 1)
        entropy = -sum(c / n * math.log2(c / n) for c in Counter(ids).values())
        out += [len(ids), sum(map(len, words)) / n, cut / n, entropy]
    return out


SAMPLES = {
    "arabic": "ذهب الولد إلى المدرسة في الصباح الباكر وكان الجو باردا جدا قال المعلم إن الدرس اليوم عن تاريخ المدينة القديمة وأهلها الذين عاشوا هنا منذ زمن بعيد",
    "hebrew": "הילד הלך לבית הספר בבוקר מוקדם והיה קר מאוד בחוץ המורה אמרה שהשיעור היום יעסוק בתולדות העיר העתיקה ובאנשים שחיו כאן לפני שנים רבות",
    "devanagari": "लड़का सुबह जल्दी स्कूल गया और बाहर बहुत ठंड थी शिक्षक ने कहा कि आज का पाठ पुराने शहर के इतिहास और यहाँ रहने वाले लोगों के बारे में है",
    "thai": "เด็กชาย ไป โรงเรียน แต่ เช้าตรู่ และ อากาศ ข้างนอก หนาวมาก ครู บอกว่า บทเรียน วันนี้ เกี่ยวกับ ประวัติศาสตร์ ของ เมืองเก่า และ ผู้คน ที่เคย อาศัย อยู่ ที่นี่",
    "greek": "Το παιδί πήγε στο σχολείο νωρίς το πρωί και έκανε πολύ κρύο έξω Ο δάσκαλος είπε ότι το σημερινό μάθημα αφορά την ιστορία της παλιάς πόλης",
    "cyrillic": "Мальчик пошел в школу рано утром и на улице было очень холодно Учитель сказал что сегодня урок об истории старого города и людях которые жили здесь",
    "cjk": "소년은 아침 일찍 학교에 갔고 밖은 매우 추웠다 선생님은 오늘 수업이 옛 도시의 역사에 관한 것이라고 말했다",
    "bengali": "ছেলেটি খুব সকালে স্কুলে গিয়েছিল এবং বাইরে খুব ঠান্ডা ছিল শিক্ষক বললেন আজকের পাঠ পুরানো শহরের ইতিহাস সম্পর্কে",
    "tamil": "சிறுவன் அதிகாலையில் பள்ளிக்குச் சென்றான் வெளியே மிகவும் குளிராக இருந்தது இன்றைய பாடம் பழைய நகரத்தின் வரலாறு பற்றியது என்று ஆசிரியர் கூறினார்",
    "georgian": "ბიჭი დილით ადრე წავიდა სკოლაში და გარეთ ძალიან ციოდა მასწავლებელმა თქვა რომ დღევანდელი გაკვეთილი ძველი ქალაქის ისტორიას ეხება",
    "armenian": "Տղան վաղ առավոտյան գնաց դպրոց և դրսում շատ ցուրտ էր Ուսուցիչն ասաց որ այսօրվա դասը հին քաղաքի պատմության մասին է",
    "other": "ልጁ በማለዳ ወደ ትምህርት ቤት ሄደ እና ውጭ በጣም ቀዝቃዛ ነበር መምህሩ የዛሬው ትምህርት ስለ አሮጌው ከተማ ታሪክ ነው አለ",
}


def shuffled(text, seed, n=120):
    rng = random.Random(seed)
    return " ".join(rng.choice(text.split()) for _ in range(n))


def letters(script, seed, n=120):
    """Random characters of a script's ranges in place of words."""
    rng = random.Random(seed)
    return " ".join("".join(chr(rng.randint(*rng.choice(quality.RANGES[script]))) for _ in range(rng.randint(2, 8))) for _ in range(n))


def test_scripts_have_bands_of_their_own(docs):
    """Prose of every script stays; random characters of it, and its text read with the wrong character set, go.

    Not so random Hebrew letters: every character of that range is a letter that both vocabularies know.
    """
    prose_rows = [(k, shuffled(t, k), None, "s") for k, t in enumerate(SAMPLES.values())]
    wrong = [(100 + k, shuffled(t, k).encode().decode("latin-1"), None, "s") for k, t in enumerate(SAMPLES.values())]
    noise = [(200 + k, letters(s, k), None, "s") for k, s in enumerate(SAMPLES) if s in quality.RANGES and s != "hebrew"]
    symbols = [(300, " ".join(chr(0x1F600 + k % 70) * 3 for k in range(80)), None, "s"), (301, " ".join(str(k * 37 % 1000) for k in range(200)), None, "s")]
    got = {r.doc_id: r for r in quality.quality_rules(docs(prose_rows + wrong + noise + symbols)).collect()}
    assert [got[k].script for k in range(len(SAMPLES))] == list(SAMPLES)
    assert [s for k, s in enumerate(SAMPLES) if not got[k].kept and not got[k].base_failed] == []
    assert [s for k, s in enumerate(SAMPLES) if got[100 + k].kept] == []
    assert [s for k, s in enumerate(SAMPLES) if 200 + k in got and got[200 + k].kept] == []
    assert got[300].script == "none" and not got[300].kept and got[301].kept


def test_fertility_against_brute_force(docs, edge_rows):
    rows = [*edge_rows, *((20 + k, shuffled(t, k), None, "s") for k, t in enumerate(SAMPLES.values())), (90, prose(7), "en", "s")]
    names = [c + tail for tail in ("", "_2") for c in ("n_tokens", "chars_per_token", "byte_share", "token_entropy")]
    got = sorted(str((r.doc_id, [round(float(r[c]), 9) for c in names])) for r in quality.quality_rules(docs(rows)).collect())
    assert got == sorted(str((i, [round(float(x), 9) for x in fertility_by_hand(t)])) for i, t, _, _ in rows)
