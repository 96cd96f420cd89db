"""Raw-zone schemas. Every evidence column is text; every row knows its case, host, source file and row number.

Fixed values: the column names follow the collected artifacts.
"""

from __future__ import annotations

from pyspark.sql import types as T

PROVENANCE = ["case_id", "host_id", "_source_file", "_rowid"]

RAW_COLUMNS = {
    "events": "timestamp Channel EventID LevelName Level Provider Computer EventRecordID ProcessID ThreadID UserID "
              "EventData _record_key _status _error log",
    "registry": "last_write key_path value_name value_type value_data _recovery hive",
    "amcache_programs": "timestamp InstallDate MsiInstallDate Name Version Publisher ProgramId ProgramInstanceId Source "
                        "RootDirPath UninstallString HiddenArp _recovery",
    "amcache_files": "timestamp link_date name lower_case_long_path original_file_name publisher product_name version "
                     "product_version bin_file_version bin_product_version size SHA1 program_id file_id binary_type "
                     "language _recovery",
    "mft_records": "path file_name extension is_directory in_use file_size entry seq parent_entry si_created si_modified "
                   "si_mft_modified si_accessed owner_id security_id fn_created fn_modified fn_mft_modified fn_accessed",
    "usn_records": "timestamp filename reason file_attributes mft_entry parent_mft_entry usn source_info security_id "
                   "file_reference parent_file_reference",
    "srum_usage": "timestamp app user AutoIncId AppId UserId",
    "jumplist_entries": "timestamp created_time modified_time app_id jumplist_type target_path arguments "
                        "working_directory machine_id stream_id _status _error",
    "prefetch_execution": "last_run_time run_time_2 run_time_3 run_time_4 run_time_5 run_time_6 run_time_7 run_time_8 "
                          "executable_filename prefetch_hash run_count format_version volume_device_path "
                          "volume_serial_number volume_creation_time _status _error",
    "prefetch_loaded_files": "executable_filename prefetch_hash loaded_filename file_reference",
    "scheduled_tasks": "timestamp task_name enabled hidden run_as run_level actions trigger_types trigger_start author "
                       "description logon_type uri _status _error",
    "error_reports": "timestamp EventType AppName AppPath TargetAppId ReportIdentifier report _status _error",
    "bitmap_cache": "kind account source_file fragment_index tile_count cols rows tile_index count width height key "
                    "image _status _error",
    "cache_entries": "request_time response_time creation_time url status content_type content_length content_encoding "
                     "server date last_modified etag cache_control location body_size body_file cache_key all_headers "
                     "body_b64 account _status _error",
    "history_urls": "url title visit_count typed_count last_visit_time",
    "history_downloads": "target_path current_path tab_url referrer site_url start_time total_bytes received_bytes "
                         "mime_type danger_type",
    "console_history": "line_number command user _status _error",
    "bookmarks": "id fullPath tableName rowid field note taggedAt hostId hostName",
}

OVERVIEW_COLUMNS = {
    "Defender": "section timestamp event_id title detail severity category action action_time process user source "
                "remediation record_key additional_actions origin detection_user",
    "RemoteDesktopHistory": "timestamp direction remote_address account description result event_id provider record_key",
    "SmbHistory": "timestamp direction remote_address account description result event_id provider record_key",
    "PowerShellHistory": "timestamp account process process_id command script_block host_application kind event_id "
                         "provider script_path record_key",
    "BrowserActivity": "account kind timestamp title url url_raw visit_count typed_count detail size size_bytes mime "
                       "danger source_url status cache_key cache_body_recovered",
    "TargetInfo": "timestamp category name value source_artifact username full_name rid rid_sam home_directory created "
                  "last_login password_last_set last_failed_login login_count failed_login_count disabled "
                  "special_account groups account_flags subnet_mask gateway dns_server dhcp_server dhcp_enabled domain "
                  "lease_obtained lease_terminates",
    "ExecutionHistory": "timestamp program_name program_path run_count focus_count focus_time_ms publisher sha1 user "
                        "source_artifact record_key prefetch_hash run_time_2 run_time_3 run_time_4 run_time_5 "
                        "run_time_6 run_time_7 run_time_8 volume_device_path volume_serial_number "
                        "volume_creation_time source_file",
    "RegistryFindings": "timestamp category name value status detail key_path source command user subtype",
    "ScheduledTasks": "timestamp task_name is_microsoft actions trigger_types trigger_start run_as run_level logon_type "
                      "enabled hidden author description uri _source_file _status _error",
    "RdpCache": "kind account source_file fragment_index tile_count cols rows width height _source_file _status",
}


def raw_schema(table: str) -> T.StructType:
    fields = [T.StructField("case_id", T.StringType()), T.StructField("host_id", T.StringType())]
    fields += [T.StructField(name, T.StringType()) for name in RAW_COLUMNS[table].split()]
    fields += [T.StructField("_source_file", T.StringType()), T.StructField("_rowid", T.LongType())]
    return T.StructType(fields)


def overview_columns(table: str) -> list[str]:
    return OVERVIEW_COLUMNS[table].split()
