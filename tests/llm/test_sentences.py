import pytest

from seqloom.llm.sentences import sentence_spans, split_sentences

CASES = [
    ("One two. Three four! Five?", ["One two.", "Three four!", "Five?"]),
    ("See Fig. 3 of Dr. Velm, e.g. here. P.-M. Orvel, J. K. Velmar et al. agree.", ["See Fig. 3 of Dr. Velm, e.g. here.", "P.-M. Orvel, J. K. Velmar et al. agree."]),
    ("It has graphs, paths, etc. This is next.", ["It has graphs, paths, etc.", "This is next."]),
    ("Is it so, etc.? Yes.", ["Is it so, etc.?", "Yes."]),
    ("Version v2.0.1 costs 8,042.0 or 3.8e-5. Done.Next one.", ["Version v2.0.1 costs 8,042.0 or 3.8e-5.", "Done.", "Next one."]),
    ("Wir kommen am 3. Mai an. Nr. 4 bleibt, z. B. hier, d.h. da.", ["Wir kommen am 3. Mai an.", "Nr. 4 bleibt, z. B. hier, d.h. da."]),
    ("A value $x_{9}=0.9$. That $f(x)\\le 54.86$ holds", ["A value $x_{9}=0.9$.", "That $f(x)\\le 54.86$ holds"]),
    ("``Is it so?'' asked the reader, who left. ``It is.'' Then all left.", ["``Is it so?'' asked the reader, who left.", "``It is.''", "Then all left."]),
    ("It says: „das ist so.“ Dann kam er.", ["It says: „das ist so.“", "Dann kam er."]),
    ("Il dit : « est-ce vrai ? » demande la suite. Oui...", ["Il dit : « est-ce vrai ? » demande la suite.", "Oui..."]),
    ("All of it (a part stays here.) Then more (see there). End", ["All of it (a part stays here.)", "Then more (see there).", "End"]),
    ("格问道：“信号保持？”这簇控制。下一句？最后", ["格问道：“信号保持？”这簇控制。", "下一句？", "最后"]),
    ("「近似し？」と述べ、定めた。次。", ["「近似し？」と述べ、定めた。", "次。"]),
    ("كل ليف، إلخ. هذا د. أورفيل مسار. هل؟ نعم", ["كل ليف، إلخ.", "هذا د. أورفيل مسار.", "هل؟", "نعم"]),
    ("वह डॉ. ओरवेल माप। कोई शेष? हर", ["वह डॉ. ओरवेल माप।", "कोई शेष?", "हर"]),
    ("กราฟลดเศษ วงจร \\cite{a} v3.8.6 หยาบในปีพ.ศ. 2574 ขอบ ผิวใหม่", ["กราฟลดเศษ", "วงจร \\cite{a} v3.8.6 หยาบในปีพ.ศ. 2574 ขอบ", "ผิวใหม่"]),
    ("First % a comment. Not this.\ngoes on. % behind\n\nSecond", ["First % a comment. Not this.\ngoes on.", "Second"]),
    ("A surface\n\\[\nx = 1.\n\\]\ngoes on.\n\n$$y$$\n\nNext", ["A surface\n\\[\nx = 1.\n\\]\ngoes on.", "Next"]),
    ("\\title{No. This}\n\\maketitle\n\\section{Not. This}\\label{a}\nText one.\n\\begin{itemize}\n\\item First\n\\item Second one.\n\\end{itemize}\n\\input{x}\n\n\\ref{a} shows.", ["Text one.", "First", "Second one.", "\\ref{a} shows."]),
    ("\\begin{table}\\caption{Not. This.}\\end{table}\n\\begin{comment}\nNo.\n\\end{comment}\n\\iffalse\nNo.\n\\fi\nYes.", ["Yes."]),
    ("\\documentclass{a}\nBefore.\n\\begin{document}\nIn.\n\\begin{thebibliography}{9}\n\\bibitem{a} No.\n\\end{thebibliography}\n\\end{document}\nBehind.", ["In."]),
    ("In.\n\\bibliography{x}\nNo.", ["In."]),
    ("", []),
    (" \n\n% only\n", []),
    ("unclosed ``quote goes. On here.", ["unclosed ``quote goes.", "On here."]),
]


@pytest.mark.parametrize("text, want", CASES)
def test_cases(text, want):
    assert [text[a:b] for a, b in sentence_spans(text)] == want


def test_lists_are_levels():
    from seqloom.llm.sentences import leveled_spans

    text = "A ``b.\n\\begin{itemize}\n\\item C.\n\\begin{enumerate}\n\\item D [e. f.] gone. Here\n\\end{enumerate}\n\\item I.\n\\end{itemize}\nJoe''. Kind"
    assert [(text[s:e], n) for s, e, n in leveled_spans(text)] == [("A ``b.", 0), ("C.", 1), ("D [e. f.] gone.", 2), ("Here", 2), ("I.", 1), ("Joe''.", 0), ("Kind", 0)]


@pytest.mark.parametrize("sign", ["(", "[", "{", "``", "„", '"(', "x (y. "])
def test_many_open_signs_take_linear_time(sign):
    import time

    began = time.time()
    assert sentence_spans(sign * 100_000)
    assert time.time() - began < 5


def test_null_and_very_long():
    assert sentence_spans(None) == []
    assert len(sentence_spans("A short sentence here. " * 50_000)) == 50_000
    assert len(sentence_spans("x" * 2_000_000)) == 1


def test_table(spark):
    d = spark.createDataFrame([(1, "Abe sees. Done.", "x"), (2, None, "x"), (3, "", "x"), (None, "E f gone.", "x"), (1, "Abe sees. Done.", "x")], "doc_id bigint, text string, sent_start string")
    got = sorted((tuple(r) for r in split_sentences(d, "doc_id", "text").drop("level").collect()), key=repr)
    assert got == [(1, 0, 9), (1, 0, 9), (1, 10, 15), (1, 10, 15), (None, 0, 9)]
    assert split_sentences(d.limit(0), "doc_id", "text").count() == 0
