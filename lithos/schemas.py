"""Shapes of the tables that operators take and return."""

from pyspark.sql import types as T

SAMPLES = T.StructType([T.StructField("sample_id", T.LongType()), T.StructField("filename", T.StringType()), T.StructField("content", T.BinaryType())])
#: A hash signature; a null size matches every size.
SIGNATURES = T.StructType([T.StructField("hash", T.StringType()), T.StructField("size", T.LongType()), T.StructField("name", T.StringType())])
FUZZY_SIGNATURES = T.StructType([T.StructField("fuzzy_type", T.StringType()), T.StructField("value", T.StringType()), T.StructField("size", T.LongType()), T.StructField("name", T.StringType()), T.StructField("sha256", T.StringType())])
#: One hit of any engine; fields that an engine does not know are null.
DETECTION = "struct<ord:int,engine:string,type:string,name:string,detail:string,size:bigint,score:int,meta:map<string,string>>"
#: What a portable executable tells of itself.
PE = """struct<machine:string,is_64bit:boolean,characteristics:string,timestamp:bigint,subsystem:string,entry_point:string,image_base:string,
sections:array<struct<name:string,vsize:bigint,rsize:bigint,raw:bigint,vaddr:bigint,flags:string,entropy:double>>,
imports:array<struct<dll:string,funcs:array<string>>>,n_imports:int,imphash:string,authentihash:string,entry_bytes:string,overlay_at:bigint,
rwx:string,entry_in_last:string>""".replace("\n", "")
