"""Column types of the relations."""

RECT = "struct<x0: double, y0: double, x1: double, y1: double>"
GLYPHS = "struct<text: array<string>, x: array<double>, y: array<double>, size: array<double>, advance: array<double>, dir_x: array<double>, dir_y: array<double>, wmode: array<int>, font_key: array<string>, font: array<string>, flags: array<int>>"
RULES = "array<struct<x0: double, y0: double, x1: double, y1: double, horizontal: boolean>>"
IMAGES = f"array<struct<width: int, height: int, bbox: {RECT}, ext: string, image: binary>>"
PAGE_ROW = f"pno int, page_count int, width double, height double, rotation int, glyphs {GLYPHS}, rules {RULES}, images {IMAGES}, error string"
PEEK_ROW = "version string, page_count int, encrypted boolean, needs_pass boolean, metadata map<string, string>, error string"
WORD = "x0 double, y0 double, x1 double, y1 double, word string, block_no long, line_no long, word_no long"
BLOCK = "x0 double, y0 double, x1 double, y1 double, text string, block_no long, type int"
SPAN = "block_no long, line_no long, span_no long, x0 double, y0 double, x1 double, y1 double, origin_x double, origin_y double, size double, font string, flags int, text string, dir_x double, dir_y double, wmode int"
HIT = "hit_no long, x0 double, y0 double, x1 double, y1 double"
TABLE = "table_no long, x0 double, y0 double, x1 double, y1 double, row_count int, col_count int, strategy string, confidence double, alignment_error_em double, minimum_gutter_em double, row_gap_variation_em double"
CELL = "table_no long, row int, col int, x0 double, y0 double, x1 double, y1 double, text string"
