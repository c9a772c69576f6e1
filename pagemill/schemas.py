"""Schemas of the stored entities as DDL. ``page_num`` is 1-based everywhere."""

JOB_STATUSES = ("queued", "processing", "completed", "failed", "cancelled")
TERMINAL_STATUSES = ("completed", "failed", "cancelled")
STREAM_STAGES = ("ocr", "merge", "complete", "failed")
CHECKPOINT_STAGES = ("ocr", "merge", "completed")


USERS = ("user_id string, email string, api_key string, created_at timestamp, is_active boolean")

FILES = (
    "file_id string, user_id string, filename string, content_type string, size_bytes bigint,"
    " page_count int, storage_bucket string, storage_path string, uploaded_at timestamp,"
    " expires_at timestamp, deleted_at timestamp, metadata string"
)

BATCHES = (
    "batch_job_id string, user_id string, status string, total_documents int,"
    " documents_completed int, overall_progress_pct double, created_at timestamp,"
    " started_at timestamp, completed_at timestamp, model string, prompt_type string,"
    " custom_prompts map<string,string>, processing_options string, output_format string,"
    " error_message string"
)

JOBS = (
    "job_id string, user_id string, file_id string, status string, total_pages int,"
    " pages_completed int, current_stage string, progress_pct double, created_at timestamp,"
    " started_at timestamp, completed_at timestamp, model string, prompt_type string,"
    " custom_prompts map<string,string>, processing_options string, output_format string,"
    " result_path string, error_message string, parent_job_id string, version_number int,"
    " parent_batch_id string"
)

PAGES = (
    "job_id string, page_num int, embedded_text string, width double, height double,"
    " has_text boolean"
)

PAGE_RESULTS = (
    "job_id string, page_num int, ocr_text string, ocr_completed_at timestamp,"
    " ocr_processing_time double, merge_text string, merge_completed_at timestamp,"
    " merge_processing_time double, metadata string"
)

OCR_CACHE = (
    "job_id string, page_num int, ocr_text string, method string, processing_time double,"
    " metadata map<string,string>"
)

JOB_EVENTS = ("event_id bigint, job_id string, event_type string, event_data string, created_at timestamp")

DIRECTORIES = ("directory_id string, name string, total_size bigint, uploaded_at timestamp")
DIRECTORY_FILES = ("directory_id string, file_id string, sequence_num bigint")

CHUNKS = ("job_id string, page_num int, chunk_sequence bigint, chunk_text string, created_at timestamp")

STREAM_ROWS = (
    "job_id string, page_num int, stage string, snapshot_text string, seq bigint,"
    " is_final boolean, error string, updated_at timestamp"
)

TEXT_BLOCKS = (
    "job_id string, page_num int, text_blocks array<struct<text:string,"
    "bbox:struct<x0:double,y0:double,x1:double,y1:double,page_width:double,page_height:double>,"
    "font_size:double,font_name:string,block_type:string>>, has_tables boolean,"
    " has_images boolean, column_count int, reading_order array<int>"
)

# One wide nullable record covers both metric samples and log events.
METRICS_LOG = (
    "timestamp string, job_id string, event_type string, active_stage string, stage_page int,"
    " stage_total_pages int, stage_progress_pct double, overall_progress_pct double,"
    " loaded_models array<string>, model_type string, model_id string, is_sharded boolean,"
    " gpu_assignment array<int>, from_stage string, to_stage string, stage string,"
    " page_number int, page_duration_s double, resolution_mode string, output_text_length int,"
    " estimated_vision_tokens int, estimated_compression_ratio double,"
    " metadata map<string,string>,"
    " process struct<rss_mb:double,vms_mb:double,cpu_percent:double>,"
    " system struct<ram_available_mb:double,ram_percent:double,cpu_percent:double>,"
    " gpus array<struct<id:int,memory_used_mb:double,memory_total_mb:double,"
    "memory_percent:double,utilization_percent:double,temperature_c:double,"
    "torch_allocated_mb:double,memory_delta_mb:double>>"
)
