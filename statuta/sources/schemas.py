"""Declared schemas; none is inferred."""

POLICY = """id string, title string, title_en string, jurisdiction string, jurisdiction_detail string, language string, tags array<string>, issuer string, issuer_code string, doc_number string,
 instrument_type string, bindingness string, ai_relevance string, status string, domain array<string>, topics array<string>, applicable_to array<string>,
 published_on date, effective_from date, effective_until date, last_verified date, supersedes array<string>, superseded_by string, amends array<string>, amended_by array<string>,
 versions array<struct<version:int,published_on:date,status:string,url:string,effective_from:date,effective_until:date,archived_url:string,content_hash:string,change_note:string>>,
 source struct<url:string,site:string,tier:string,fetched_at:string,http_status:int,content_hash:string,snapshot_path:string>,
 key_obligations array<struct<clause:string,summary:string,obligation_type:string,tags:array<string>>>, verified_by string, verified_note string, notes string"""
PENALTY = """id string, decision_no string, party string, party_type string, violation_type string, penalty_content string, authority string, legal_basis string, decision_date string,
 published_on date, publicity_period string, domain array<string>, related_policies array<string>, jurisdiction string,
 source struct<url:string,site:string,fetched_at:string,tier:string,http_status:int>, last_verified date, verified_by string, notes string"""
CHANGE = "change_type string, policy_id string, title string, detected_on string, significance string, detail string, url string, fields array<string>, extra map<string,string>"
DAY = f"detected_on string, generated_at string, policies_scanned int, change_count int, high_significance_count int, failed_sources array<string>, changes array<struct<{', '.join(':'.join(x.split(' ', 1)) for x in CHANGE.split(', '))}>>"
LEDGER = """ts string, kind string, policy_id string, check_id string, option_key string, label string, evidence string, mode string, reason string,
 decisions array<struct<check_id:string,option_key:string,label:string>>, changes array<string>, evidence_excerpt_count int, card_path string, errors array<string>"""
