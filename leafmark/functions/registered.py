"""Functions for users of SQL: spellings as temporary SQL functions, and chunks of verses as a table function.

The SQL bodies say the same as the expressions in arabic.py, with its fixed values, and are inlined by the optimizer like any expression."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

from leafmark.functions import arabic as A
from leafmark.sources.shared import ship

_TIGHT = f"translate(w, '{A.ALEF_FORMS}ى', '{A.ALEF * len(A.ALEF_FORMS)}ي')"
_BODIES = {
    "letters_of(word STRING) RETURNS STRING": f"regexp_replace(word, '[{A.MARKS}]', '')",
    "word_pieces(word STRING) RETURNS ARRAY<STRING>": f"filter(split(regexp_replace(regexp_replace(regexp_replace(word, '[{A.MARKS}]', ''), '([{A.NON_JOINERS}])', '$1|'), '([{A.NON_RECEIVERS}])', '|$1'), '[|]'), x -> x <> '')",
    "piece_count(word STRING) RETURNS INT": "greatest(1, size(word_pieces(word)))",
    "dots_above(word STRING) RETURNS INT": f"char_length(letters_of(word)) - char_length(regexp_replace(letters_of(word), '[{A.DOTS_ABOVE}]', ''))",
    "dots_below(word STRING) RETURNS INT": f"char_length(letters_of(word)) - char_length(regexp_replace(letters_of(word), '[{A.DOTS_BELOW}]', ''))",
    "folded_start(words ARRAY<STRING>, n INT) RETURNS STRING": f"translate(regexp_replace(array_join(slice(words, 1, n), ''), '[{A.MARKS}]', ''), '{A.ALEF_FORMS}', '{A.ALEF * len(A.ALEF_FORMS)}')",
    "without_formula(words ARRAY<STRING>, chapter BIGINT, verse BIGINT) RETURNS ARRAY<STRING>": f"""CASE WHEN verse <> 1 OR chapter IN (1, 9) THEN words
      WHEN size(words) > 4 AND folded_start(words, 4) = '{A.FORMULA}' THEN slice(words, 5, size(words)) WHEN size(words) > 3 AND folded_start(words, 3) = '{A.FORMULA}' THEN slice(words, 4, size(words)) ELSE words END""",
    "tight_forms(word STRING) RETURNS ARRAY<STRING>": f"transform(array(regexp_replace(word, '[{A.MARKS}]', ''), regexp_replace(translate(word, '{A.DAGGER}', '{A.ALEF}'), '[{A.MARKS}]', '')), w -> {_TIGHT})",
    "loose_forms(word STRING) RETURNS ARRAY<STRING>": f"transform(tight_forms(word), w -> translate(w, '{A.HAMZAS}', ''))",
    "bare_forms(word STRING) RETURNS ARRAY<STRING>": f"transform(loose_forms(word), w -> translate(w, '{A.ALEFS}', ''))",
    "match_level(a STRING, b STRING) RETURNS INT": "CASE WHEN arrays_overlap(tight_forms(a), tight_forms(b)) THEN 0 WHEN arrays_overlap(loose_forms(a), loose_forms(b)) THEN 1 WHEN arrays_overlap(bare_forms(a), bare_forms(b)) THEN 2 END",
}


class VerseChunks:
    """Entries of one island in order, cut after `target` distinct lines at ends of verses; see operators.planning.chunks.

    Rows have page_number, line_number, chapter, verse, and next_chapter and next_verse, the verse that follows (null at the end of all)."""

    def __init__(self) -> None:
        self.entries: list[tuple] = []
        self.target = 0

    def eval(self, row: Row, target: int) -> None:
        self.target = target
        following = None if row["next_chapter"] is None else (row["next_chapter"], row["next_verse"])
        self.entries.append((row["page_number"], row["line_number"], (row["chapter"], row["verse"]), following))

    def terminate(self) -> Iterator[tuple]:
        if not self.entries:
            return
        begin, end, lines, place, chunk = self.entries[0][2], self.entries[-1][2], 0, None, 0
        for page, line, verse, following in self.entries:
            lines, place = lines + ((page, line) != place), (page, line)
            if lines >= self.target and verse < end and following is not None and following <= end:
                yield (chunk, *begin, *verse)
                begin, lines, chunk = following, 1, chunk + 1
        yield (chunk, *begin, *end)


def register(spark: SparkSession) -> list[str]:
    """Makes the functions known to the session and gives their names."""
    ship(spark)
    for head, body in _BODIES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    spark.udtf.register("verse_chunks", udtf(VerseChunks, returnType="chunk long, from_chapter long, from_verse long, to_chapter long, to_verse long"))
    return [head.split("(")[0] for head in _BODIES] + ["verse_chunks"]
