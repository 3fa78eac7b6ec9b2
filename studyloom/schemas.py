"""Schemas of the input and output tables. Identifiers that look numeric but carry zeros are strings."""

from __future__ import annotations

IMAGE_META = "subject_id long, study_id long, dicom_id string, StudyDate string, StudyTime double, ViewPosition string"
IMAGE_PATH = "dicom_id string, path string"
STUDY_LIST = "subject_id long, study_id long, path string"
ADMISSION = "subject_id long, hadm_id long, admittime timestamp, dischtime timestamp"
DIAGNOSIS = "subject_id long, hadm_id long, seq_num int, icd_code string"
ICD_TITLE = "icd_code string, long_title string"
DRG = "hadm_id long, drg_type string, description string, drg_severity double, drg_mortality double"
SPLIT = "study_id long, split string"
PREDICTION = "study_id string, real_report string, generated_report string, selected_method string"
HISTORY = (
    "array<struct<hadm_id:bigint,admittime:string,dischtime:string,"
    "diagnoses:array<struct<seq_num:int,icd_code:string,description:string>>,"
    "drg:struct<description:string,drg_severity:double,drg_mortality:double>>>"
)
REPORT_ENTITIES = "map<string,struct<tokens:string,label:string,relations:array<array<string>>>>"
VECTOR = "study_id long, vec array<float>"

METRIC_COLUMNS = (
    "eval_timestamp", "report_file", "BLEU-1", "BLEU-2", "BLEU-3", "BLEU-4", "METEOR", "ROUGE-L", "CIDEr",
    "RadGraph_F1", "CheXpert_F1", "CheXpert_P", "CheXpert_R",
)
