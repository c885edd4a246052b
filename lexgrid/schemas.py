"""Explicit schemas of the corpus and evaluation tables, as DDL."""

from __future__ import annotations

SCRAPED = "regulation_number string, title string, year string, category string, date_enacted string, date_promulgated string, detail_url string, documents array<struct<url:string,file_type:string,extension:string,filename:string,local_path:string>>"
ARTICLE = "regulation_id string, article_number string, content string, raw_text string, references array<struct<article:string,ayat:string>>, cross_regulation_references array<struct<regulation_id:string,article_number:string,ayat:string>>, defines array<string>, source_format string"
REGULATION = "regulation_id string, title string, category string, year string, date_enacted string, date_promulgated string, amends array<struct<regulation_id:string,action:string>>"
EVAL_ITEM = "id string, question string, gold_article_ids array<string>, gold_answer string, hop_type string, notes string"
RUN_RESULT = "id string, question string, gold_article_ids array<string>, gold_answer string, hop_type string, answer string, retrieved_ids array<string>, contexts array<string>, sources array<string>, latency_s double, system string, meta map<string,string>"
SPLIT = "seed long, dev_frac double, dev array<string>, test array<string>"
