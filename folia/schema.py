"""Schemas of the engine's tables."""

from pyspark.sql import types as T


def _of(text: str) -> T.StructType:
    return T._parse_datatype_string(text)


CATALOG = "path string, folder string, rel string, bytes bigint, mtime timestamp, sha1 string, head binary"
PAGE = ("path string, page_no int, text string, width_pt double, height_pt double, rotate int, "
        "images array<struct<w:int,h:int,mask:boolean,cs:string,bpc:int,depth:int>>, readable boolean")
OP = "path string, page_no int, stream string, depth int, pos int, stop int, kind string, arg string"
RASTER = "path string, page_no int, dpi int, ink_frac double, coverage double, is_color boolean"
RESULT = ("path string, rel string, orig bigint, new bigint, action string, reason string, ocr string, lang string, kept boolean, "
          "types map<string,int>, note string, err string, seq bigint")
NODE = "file string, num bigint, gen int, kind string, sha1 string, bytes bigint, head string"
EDGE = "file string, src bigint, dst bigint"
PART = "folder string, name string, ord bigint, w int, h int, is_pdf boolean, pages int"
