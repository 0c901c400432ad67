"""Declared schemas of the nested inputs. Nothing is inferred."""

BOX = "struct<x:double,y:double,width:double,height:double>"
DOCUMENT = "struct<document_id:string,document_version:string,page_index:int>"
FRAME = "struct<space:string,dpi:double,width:int,height:int,origin:string,y_axis:string>"

SCAN_RESULT = (f"format string, format_version int, scan_id string, document {DOCUMENT}, coordinate_frame {FRAME}, "
               "detector struct<name:string,version:string,settings:map<string,string>>, template struct<sha256:string,template_id:string>, "
               "metadata map<string,string>, provenance string, created_at string, elapsed_seconds double, "
               f"detections array<struct<id:string,x:double,y:double,score:double,confidence:double,rotation:int,source:string,class_label:string,box:{BOX}>>, "
               "_corrupt_record string")

DETECTIONS = (f"format string, format_version int, provenance string, scan_id string, document {DOCUMENT}, coordinate_frame {FRAME}, "
              "detector struct<name:string,version:string,settings:map<string,string>>, elapsed_seconds double, runtime struct<elapsed_seconds:double>, mode string, "
              f"detections array<struct<id:string,x:double,y:double,confidence:double,score:double,source:string,box:{BOX}>>, _corrupt_record string")

GROUND_TRUTH = ("format string, format_version int, dataset struct<dataset_id:string,labeled_by:string,labeled_at:string,notes:string,"
                "verification:struct<status:string,independent_of_detector:boolean,method:string,reviewed_by:string,exhaustive_miss_check:boolean,source_scan_id:string>>, "
                f"document {DOCUMENT}, coordinate_frame {FRAME}, receptacles array<struct<id:string,x:double,y:double>>, _corrupt_record string")

MANIFEST = ("format string, format_version int, corpus_id string, description string, tolerance_px double, tolerance_rel double, "
            "pages array<struct<detections:string,ground_truth:string,document:string,tags:array<string>,document_version:string,page_index:int>>, _corrupt_record string")

LEGEND = ("format string, format_version int, pdf_sha256 string, page_index int, engineer string, heading string, "
          "entries array<struct<id:string,tag:string,tag_source:string,name:string,description:string,group:string,count:boolean,not_counted_reason:string,"
          "symbol_boxes:array<array<double>>,labels:array<string>,flags:array<string>,source:string,confirmed:boolean,signatures:array<string>>>, _corrupt_record string")

LIBRARY = ("format string, format_version int, engineer string, updated_at string, "
           "entries array<struct<tag:string,name:string,description:string,group:string,count:boolean,signatures:array<string>,projects:array<string>,updated_at:string>>, "
           "_corrupt_record string")

TRAINING_MANIFEST = ("dataset_id string, verifier array<struct<sample_id:string,split:string,path:string,label:int,canonical_page_id:string,document_id:string,x:double,y:double,"
                     "source_example_id:string,sha256:string>>, detector array<struct<page_key:string,split:string,path:string,canonical_page_id:string,document_id:string,"
                     "width:int,height:int,points:array<array<double>>>>, _corrupt_record string")

OCR_TSV = ("level int, page_num int, block_num int, par_num int, line_num int, word_num int, left double, top double, width double, height double, conf double, text string, "
           "_corrupt_record string")

POINTS_CSV = "x double, y double, page int, document string, id string, version string, width int, height int, _corrupt_record string"
