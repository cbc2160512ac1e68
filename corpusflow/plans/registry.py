"""Name -> query callable, in inventory order."""

from __future__ import annotations

from corpusflow.plans import file_queries as FQ
from corpusflow.plans import queries as Q

QUERIES = {
    "segments": Q.q_segments,
    "segment_stats_by_lang": Q.q_segment_stats_by_lang,
    "segment_table": Q.q_segment_table,
    "segment_stats": Q.q_segment_stats,
    "clean_text": Q.q_clean_text,
    "paragraphs": Q.q_paragraphs,
    "strip_ws": Q.q_strip_ws,
    "truncate_input": Q.q_truncate_input,
    "excerpt": Q.q_excerpt,
    "max_output_tokens": Q.q_max_output_tokens,
    "split_continuation": Q.q_split_continuation,
    "continuation_samples": Q.q_continuation_samples,
    "writing_samples": Q.q_writing_samples,
    "revision_samples": Q.q_revision_samples,
    "build_dataset": Q.q_build_dataset,
    "dataset_counts": Q.q_dataset_counts,
    "messages_jsonl": Q.q_messages_jsonl,
    "prompt_only_messages": Q.q_prompt_only_messages,
    "legacy_user_content": Q.q_legacy_user_content,
    "attach_task": Q.q_attach_task,
    "attach_task_per_row": Q.q_attach_task_per_row,
    "reverse_prompts": Q.q_reverse_prompts,
    "render_request": Q.q_render_request,
    "assign_batches": Q.q_assign_batches,
    "workload_summary": Q.q_workload_summary,
    "infer_columns": Q.q_infer_columns,
    "resume": Q.q_resume,
    "outcome_stats": Q.q_outcome_stats,
    "result_lengths": Q.q_result_lengths,
    "quality_report": Q.q_quality_report,
    "sample_preview": Q.q_sample_preview,
    "writing_samples_model": Q.q_writing_samples_model,
    "revision_samples_model": Q.q_revision_samples_model,
    "segment_stream": Q.q_segment_stream,
    "infer_stream": Q.q_infer_stream,
    "corpus_lines_by_lang": Q.q_corpus_lines_by_lang,
    "written_messages": Q.q_written_messages,
    "written_segments": Q.q_written_segments,
    "processed_csv": Q.q_processed_csv,
    "paragraph_blocks_by_lang": Q.q_paragraph_blocks_by_lang,
    "delimited_roundtrip": Q.q_delimited_roundtrip,
} | FQ.QUERIES
