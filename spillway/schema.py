"""Schemas of the engine's tables."""

from __future__ import annotations

#: A unit of content.
ITEM = "item_id long, text string, source string, path string, meta map<string,string>"
#: A located candidate in one item; start and stop are UTF-8 byte offsets, half open.
MATCH = "struct<type:string,category:string,value:string,start:int,stop:int,confidence:double,checksum_valid:boolean,stage:string>"
#: What a scan returns for an item, before the raw value is dropped.
RAW = (
    "struct<detector:string,type:string,category:string,confidence:double,severity:string,line:int,col:int,start:int,stop:int,"
    "value:string,stage:string,name:string,text:string,rationale:string>"
)
#: The output record.  The raw value isn't part of it.
FINDING = (
    "detector string, type string, confidence double, severity string, source string, path string, line int, col int, redacted string, "
    "stage string, url string, verified boolean, rationale string, fingerprint string, context struct<name:string,line:string>, "
    "in_final_image boolean, instruction string"
)
SEVERITIES = ("info", "low", "medium", "high", "critical")
RANK = {s: k for k, s in enumerate(SEVERITIES)}
