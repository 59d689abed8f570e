"""Small documents with every awkward case, for all operators."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, words string, size string, key string, node string, fp string, text_hash string, gone string, n_words string, __0_text string, __0_key string, __l_text string, __q_text string, __m_size string, __s_hash string, `a.b` string, Kept string, N_Lines string"

LINE = "this very line stands in many documents and is longer than forty characters"
PROSE = "the old house by the river was sold to a friend of the family and the garden with its many trees was left as it had been for years because nobody in the village wanted to change what they had known since they were young and the winter was near"


def rows():
    extra = ("x",) * 17
    texts = {
        1: PROSE,
        2: PROSE,
        3: f"{PROSE}\n{LINE}",
        4: f"{LINE}\n  {LINE.upper()} \nshort\n\n{PROSE} and then some more was said",
        5: None,
        6: "",
        7: " \n\t ",
        8: f"{LINE}",
        9: f"{LINE}\nother words entirely, licensed under the MIT License. ␛ </s>[INST]",
        10: f"{LINE}\nÄpfel und Öl mit ß, naïve café 教学 🎮",
        11: "word " * 30_000,
        12: "\n".join(f"{PROSE} number {k} of the lines" for k in range(400)),
    }
    made = [(k, t, "en", f"src{k % 3}", len(t) if t else 0, *extra) for k, t in texts.items()]
    made += [made[2], made[2], (None, PROSE + " none", "fr", None, None, *extra), (None, LINE, None, None, 1, *extra), (13, "a tie", None, None, 5, *extra)]
    return made


def documents(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
