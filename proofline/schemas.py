"""Schemas of the tables that operators exchange.

Those of functions that run in Python workers are objects: a worker has no parser for text."""

from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

RUN = "struct<run_idx:int,text:string,bold:boolean,italic:boolean,underline:boolean,font:string,size:string,color:string,highlight:string,style:string>"
PARAGRAPHS = f"doc_id string, para_idx int, section string, style string, text string, runs array<{RUN}>"
EDITS = ArrayType(
    StructType([
        StructField("type", StringType()),
        *[StructField(c, IntegerType()) for c in ("orig_start", "orig_end", "corr_start", "corr_end")],
        StructField("orig_text", StringType()),
        StructField("corr_text", StringType()),
    ])
)
VERDICT = "struct<is_safe:boolean,reason:string,edit_ratio:double,length_delta:double>"
FEEDBACK = (
    "document_id string, paragraph_id int, edit_id string, model_mode string, original_text string, corrected_text string, "
    "user_suggested_text string, user_label string, status string, reason string, edit_ratio double, length_delta_ratio double, confidence double, timestamp string"
)
REVIEW = (
    "edit_id string, document_id string, paragraph_id int, original_text string, corrected_text string, status string, reason string, "
    "edit_ratio double, length_delta_ratio double, confidence double, timestamp string"
)
CACHE = "corrector string, source string, corrected string"
