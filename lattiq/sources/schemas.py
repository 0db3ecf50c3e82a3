"""Explicit schemas as DDL; nothing is inferred."""

MANIFEST = "id string, audio string, text string, duration_s double, lang string, `set` string, cluster string, rank int, subset string"
CANDIDATE = "struct<text:string,avg_conf:double,min_conf:double,median_conf:double,mean_logprob:double,mean_entropy:double,n_tokens:int,word_conf:array<double>,tokens:array<int>,word_dist:array<struct<first:int,ids:array<int>,p:array<double>>>,rank:int,source:string>"
DUMP = f"id string, dataset string, lang string, cluster string, model string, arm string, duration_s double, encode_s double, decode_s double, reference string, n_unique int, identical_after_step1 boolean, n_candidates_used int, uncertainty double, branch_widths array<int>, score_s double, candidates array<{CANDIDATE}>"
PLAN = "id string, model string, family string, `set` string, lang string, shard int, shard_size int, kind string, arms array<struct<name:string,K:int,T:double,steps:int,mode:string,beams:int>>, tier int, `order` int, precision string"
DONE = "job string, model string, lane string, n_ok int, n_err int, audio_s double, encode_s double, decode_s map<string,double>, started double, status string, wall_s double, n_in_shard int, n_resumed int, peak_mem_mb double"
