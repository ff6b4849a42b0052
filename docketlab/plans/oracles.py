"""SQL twins of the catalogue, for any engine that reads the same tables (checked with DuckDB)."""

from __future__ import annotations

_NORM = r"""trim(regexp_replace(regexp_replace(regexp_replace(lower(coalesce({c},'')),'[“”‘’]','''','g'),'[^a-z0-9$#./'' -]+',' ','g'),'[ \t\n\r\f]+',' ','g'))"""
_WORDS = r"""trim(regexp_replace(upper(coalesce({c},'')),'[^A-Z0-9]+',' ','g'))"""
_MISSING = "('','NOT STATED','NEEDS REVIEW','UNKNOWN','NOT PROVIDED','N A','NA')"
_COMPACT = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce({c},''),'\x00',' ','g'),'[ \t]+',' ','g'),'\n{{3,}}',chr(10)||chr(10),'g'),'^[ \n]+|[ \n]+$','','g')"""
_LIENS = """select o_custkey packet, o_orderkey lien, case o_orderstatus when 'O' then 'OPEN' when 'F' then 'RELEASED' else 'UNKNOWN' end status,
 cast(o_orderdate as date) recorded, case when o_orderkey%3>0 then o_orderkey end sequence,
 case when o_orderkey%7=0 then 'Federal Tax Lien' when o_orderkey%7<5 then 'Deed of Trust' else 'Judgment Lien' end kind from orders"""
_CALM = f"select packet, lien, case status when 'UNKNOWN' then 'RELEASED' else status end status, recorded, lien sequence, kind from ({_LIENS})"
_STACK = """ranked as (select *, row_number() over (partition by packet,status order by recorded nulls last, sequence nulls last, lien) turn,
 count(*) over (partition by packet,status,recorded) peers, sum(case when sequence is null then 1 else 0 end) over (partition by packet,status,recorded) bare,
 min(case when status='UNKNOWN' then recorded end) over (partition by packet) fu from src),
 blocked as (select *, case when status<>'OPEN' then null when recorded is null then 'UNDATED' when fu<=recorded then 'UNKNOWN_STATUS' when peers>1 and bare>0 then 'SAME_DAY' end blocker from ranked),
 placed as (select *, case when status='OPEN' and blocker is null then turn end pos, case when kind='Federal Tax Lien' then 'TAX' else '' end exc from blocked),
 stack as (select *, pos as position, case when status='RELEASED' then 'high' when pos is null then 'low' when exc<>'' then 'medium' else 'high' end confidence,
 case when pos is not null then 'FIRST_IN_TIME' else 'UNRESOLVED' end basis from placed)"""
_NTH = "(case when {n}%100 between 11 and 13 then 'th' when {n}%10=1 then 'st' when {n}%10=2 then 'nd' when {n}%10=3 then 'rd' else 'th' end)"
_TARGETS = """targets as (select packet, case when bool_or(kind='Deed of Trust' and status='UNKNOWN') or sum(case when sec then 1 else 0 end)=0 then null
 when sum(case when sec then 1 else 0 end)=1 then min(case when sec then lien end)
 when sum(case when sec and lien%2<>0 then 1 else 0 end)=0 then min(case when sec and position=1 and confidence='high' then lien end) end target
 from (select *, (kind='Deed of Trust' and status='OPEN') sec from stack) group by packet)"""
_SIDES = """sides as (select s.packet, s.lien, case when s.position<t.position then 'senior' when s.position>t.position then 'junior' else 'target' end side
 from stack s join (select s.packet, s.position from stack s join targets t on s.packet=t.packet and s.lien=t.target where s.status='OPEN' and s.position is not null) t on s.packet=t.packet
 where s.status='OPEN' and s.position is not null)"""
_REQS = """reqs as (
 select distinct packet, 'TARGET_LIEN_SELECTION' code, 'EVIDENCE' as type, 'BLOCKING' severity from stack where packet not in (select packet from targets where target is not null)
 union all select s.packet,'TARGET_LIEN_POSITION','PRIORITY_REVIEW','BLOCKING' from stack s join targets t on s.packet=t.packet and s.lien=t.target where s.position is null
 union all select s.packet,'PRIORITY_EXCEPTION_REVIEW','PRIORITY_REVIEW','REVIEW' from stack s join targets t on s.packet=t.packet and s.lien=t.target where exc<>''
 union all select s.packet,'FIRST_IN_TIME_CONFIDENCE','PRIORITY_REVIEW','REVIEW' from stack s join targets t on s.packet=t.packet and s.lien=t.target where basis='FIRST_IN_TIME' and confidence<>'high'
 union all select packet,'LIEN_STATUS_'||lien,'EVIDENCE','REVIEW' from stack where status='UNKNOWN'
 union all select packet,'SENIOR_'||lien,'PAYOFF_REVIEW','REVIEW' from sides where side='senior'
 union all select packet,'JUNIOR_'||lien,'NOTICE_REVIEW','REVIEW' from sides where side='junior'
 union all select s.packet,'STACK_EXCEPTION_'||s.lien,'PRIORITY_REVIEW','REVIEW' from stack s left join targets t on s.packet=t.packet and s.lien=t.target where s.status='OPEN' and exc<>'' and t.target is null)"""
_CAND = "select user_id as key, event_id as ord, length(props) chars, event_id%17 signals, (event_id%100)/100.0::double confidence from events"
_IDS = """['CURRENT_OWNER_ESTABLISHED','PRIOR_OWNER_ESTABLISHED','OWNERSHIP_CHAIN_COMPLETE','TARGET_LIEN_FOUND','TARGET_LIEN_AMOUNT','TARGET_LIEN_POSITION_ESTABLISHED','HOA_STATUS_REVIEWED','CCRS_REVIEWED','HOA_NAME_AMOUNTS_REVIEWED','DEED_MORTGAGE_ACCURACY','RECORDED_DOCUMENTS_RECONCILE','RECORDING_ORDER_RECONCILES','ASSIGNMENT_CHAIN_COMPLETE','LEGAL_DESCRIPTION_RECONCILES','MERS_BENEFICIARY_REVIEWED','FEDERAL_TAX_LIEN_REVIEWED','RELEASES_RECONCILED','PROPERTY_IDENTITY_RECONCILES','LOAN_DOCUMENT_TYPE_REVIEWED','LOAN_RECORDING_DATE_REVIEWED','LOAN_STATUS_REVIEWED','RECOURSE_REVIEWED','MATERIAL_REPORT_ERRORS_REVIEWED','PLAT_REQUIREMENT_REVIEWED','MIN_RUN_SHEET_REVIEWED','RUN_SHEET_RECONCILES']"""
_CHECKS = f"select user_id, cast(ts as date) as day, {_IDS}[event_id%26+1] check_id, case event_type when 'signup' then 'CANNOT_CONFIRM' when 'error' then 'FAIL' else 'PASS' end status, event_id, ts from events"
_META = """meta(check_id,code,severity) as (values ('CURRENT_OWNER_ESTABLISHED','CURRENT_OWNER_UNRESOLVED','BLOCKING'),('PRIOR_OWNER_ESTABLISHED','PRIOR_OWNER_UNRESOLVED','BLOCKING'),('OWNERSHIP_CHAIN_COMPLETE','OWNERSHIP_CHAIN_GAP','BLOCKING'),('TARGET_LIEN_FOUND','TARGET_LIEN_UNRESOLVED','BLOCKING'),('TARGET_LIEN_AMOUNT','TARGET_LIEN_AMOUNT_UNRESOLVED','BLOCKING'),('TARGET_LIEN_POSITION_ESTABLISHED','LIEN_POSITION_UNRESOLVED','BLOCKING'),('HOA_STATUS_REVIEWED','HOA_STATUS_UNRESOLVED','REVIEW'),('CCRS_REVIEWED','CCRS_UNRESOLVED','REVIEW'),('HOA_NAME_AMOUNTS_REVIEWED','HOA_DETAILS_UNRESOLVED','REVIEW'),('DEED_MORTGAGE_ACCURACY','DEED_MORTGAGE_ACCURACY','BLOCKING'),('RECORDED_DOCUMENTS_RECONCILE','MISSING_OR_MISMATCHED_RECORDING','BLOCKING'),('RECORDING_ORDER_RECONCILES','RECORDING_CHAIN_ORDER_ISSUE','REVIEW'),('ASSIGNMENT_CHAIN_COMPLETE','ASSIGNMENT_CHAIN_GAP','BLOCKING'),('LEGAL_DESCRIPTION_RECONCILES','LEGAL_DESCRIPTION_DISCREPANCY','BLOCKING'),('MERS_BENEFICIARY_REVIEWED','MERS_BENEFICIARY_REVIEW','REVIEW'),('FEDERAL_TAX_LIEN_REVIEWED','FEDERAL_TAX_LIEN_REVIEW','BLOCKING'),('RELEASES_RECONCILED','RELEASE_SATISFACTION_ISSUE','BLOCKING'),('PROPERTY_IDENTITY_RECONCILES','PROPERTY_IDENTITY_ISSUE','BLOCKING'),('LOAN_DOCUMENT_TYPE_REVIEWED','LOAN_DOCUMENT_TYPE_UNRESOLVED','REVIEW'),('LOAN_RECORDING_DATE_REVIEWED','LOAN_RECORDING_DATE_UNRESOLVED','REVIEW'),('LOAN_STATUS_REVIEWED','LOAN_STATUS_UNRESOLVED','REVIEW'),('RECOURSE_REVIEWED','RECOURSE_UNRESOLVED','REVIEW'),('MATERIAL_REPORT_ERRORS_REVIEWED','MATERIAL_REPORT_ERROR','QC'),('PLAT_REQUIREMENT_REVIEWED','PLAT_MAP_ISSUE','QC'),('MIN_RUN_SHEET_REVIEWED','MIN_SUMMARY_ISSUE','QC'),('RUN_SHEET_RECONCILES','RUN_SHEET_ACCURACY','QC'))"""
_ISSUES = """issues as (select c.user_id packet, c.check_id, case when status='CANNOT_CONFIRM' then 'CANNOT_CONFIRM_'||code else code end code,
 case when status='CANNOT_CONFIRM' and severity='QC' then 'REVIEW' else severity end severity, status='CANNOT_CONFIRM' unresolved, c.event_id
 from checks c join meta using(check_id) where status in ('FAIL','CANNOT_CONFIRM'))"""
_DOC = "select source packet, doc_id page, text, n_chars char_count from documents"
_GROUND = f"""q as (select item_id quote_id, text quote, {_NORM.format(c="text")} q from benchmark),
 qt as (select *, list_filter(string_split(q,' '), lambda t: length(t)>1) ts from q where q<>''),
 p as (select doc_id page_id, {_NORM.format(c="text")} p from documents),
 pair as (select quote_id, page_id, contains(p.p,qt.q) as exact, len(list_filter(ts, lambda t: list_contains(string_split(p.p,' '),t))) matched, len(ts) total from qt, p
  where contains(p.p,qt.q) or length(p.p)>0),
 found as (select * from pair where exact or (total>=4 and matched/total>=0.82))"""
_NAMES = "string_agg({x}::varchar, ',' order by {x})"
_EXPORT = """select o_orderkey as key, case when o_orderkey%9=0 then 'Needs "review"' else c_name end as owner, case when o_orderstatus='P' then 'Needs review' else o_orderpriority end as position, cast(cast(o_totalprice as decimal(18,2)) as varchar) as amount from orders join customer on o_custkey=c_custkey"""
_EDGES = """e as (select distinct 'c'||o_custkey src, 'o'||o_orderkey dst, 'PARTY_TO' as type from orders union select distinct 'o'||l_orderkey, 'p'||l_partkey, 'REPORTS' from lineitem)"""
_SUMS = """line as (select l_orderkey number, sum(cast(l_extendedprice as decimal(18,2))) amount from lineitem group by 1), own as (select o_orderkey number, cast(o_totalprice as decimal(18,2)) source_amount from orders),
 m as (select number, amount, source_amount, case when source_amount is null then 'SOURCE_MISSING' when abs(amount-source_amount)*2<=source_amount then 'MATCHED' else 'MISMATCHED' end status from line left join own using(number))"""
_CHAIN = """deeds as (select o_custkey packet, o_orderkey deed, o_orderdate dated, substr(o_orderpriority,1,1) grantee, (o_orderkey%5+1)::varchar g2 from orders),
 links as (select packet, deed, case when lead(deed) over w is null then null else grantee in (lead(grantee) over w, lead(g2) over w) end continues from deeds window w as (partition by packet order by dated, deed))"""

ORACLES: dict[str, str] = {
    "lien_position": f"with src as ({_LIENS}), {_STACK} select packet, lien, position, case when position is not null then position||{_NTH.format(n='position')}||' Lien' else 'Needs review' end as label, basis, confidence from stack where status='OPEN'",
    "lien_blockers": f"with src as ({_LIENS}), {_STACK} select status, coalesce(blocker,'-') blocker, count(*) n from stack group by 1,2",
    "lien_tie_ambiguity": f"with src as (select packet,lien,status,date_trunc('month',recorded) recorded,sequence,kind from ({_LIENS}) where status='OPEN'), {_STACK} select packet, lien, coalesce(blocker,'-') blocker from stack",
    "lien_status_counts": f"select packet, sum((status='OPEN')::int)::bigint as open, sum((status='RELEASED')::int)::bigint released, sum((status='UNKNOWN')::int)::bigint as unknown from ({_LIENS}) group by 1",
    "auto_target": f"with src as ({_CALM}), {_STACK}, {_TARGETS} select * from targets where target is not null",
    "senior_junior_split": f"with src as ({_CALM}), {_STACK}, {_TARGETS}, {_SIDES} select * from sides",
    "evidence_through_target": f"with src as ({_CALM}), {_STACK} select packet, lien, position, string_agg(lien::varchar, ',') over (partition by packet order by position rows between unbounded preceding and current row) evidence from stack where position is not null",
    "foreclosure_requirements": f"with src as ({_LIENS}), {_STACK}, {_TARGETS}, {_SIDES}, {_REQS} select distinct * from reqs",
    "foreclosure_status": f"with src as ({_LIENS}), {_STACK}, {_TARGETS}, {_SIDES}, {_REQS}, d as (select distinct * from reqs) select s.packet, case when bool_or(severity='BLOCKING') then 'CURATIVE_REQUIRED' when count(code)>0 then 'REVIEW' else 'READY' end status, count(code) n from (select distinct packet from stack) s left join d using(packet) group by 1",
    "page_hint": r"select doc_id page, case when regexp_matches(text,'(?i)license|copyright') then 'License' when regexp_matches(text,'[A-Za-z0-9._]+@[a-z0-9.]+') then 'Contact' when regexp_matches(text,'(?i)\b(?:token|secret|password) =') then 'Secret' when length(text)<200 then 'Short' else 'Unclassified' end hint from documents",
    "front_summary_score": r"select doc_id page, (regexp_matches(text,'(?i)license')::int + contains(text,'@')::int + regexp_matches(text,'\d{3}')::int + contains(text,'!!')::int + contains(text,'|')::int + contains(text,'$$')::int + regexp_matches(text,'(?i)\bthe\b')::int + regexp_matches(text,'(?i)\bder\b')::int)::bigint score from documents",
    "order_type_detect": rf"with c as (select doc_id page, substr({_COMPACT.format(c='text')},1,30000) t from documents) select * from (select page, case when regexp_matches(t,'(?i)\blicensed under the [a-z]+') then 'Licensed' when regexp_matches(t,'[a-z0-9._]+@[a-z0-9.]+') then 'Contact' when regexp_matches(t,'\| [a-z]+ \|') then 'Table' end order_type from c) where order_type is not null",
    "normalize_text": f"select doc_id page, sha256({_NORM.format(c='text')}) norm from documents",
    "compact_whitespace": f"select doc_id page, sha256({_COMPACT.format(c='text')}) compact from documents",
    "page_ledger": f"select packet, count(*) page_count, sum(char_count)::bigint chars, sum((char_count>=80)::int)::bigint readable, sum((char_count=0)::int)::bigint blank, coalesce(string_agg(page::varchar, ',' order by page) filter (char_count<80),'') low_pages, round(sum((char_count>=80)::int)/count(*),4) coverage, sum(char_count)>=2000 and sum((char_count>=80)::int)/count(*)>=0.9 ready from ({_DOC}) group by 1",
    "low_text_budget": f"select packet, page, row_number() over (partition by packet order by page) turn, row_number() over (partition by packet order by page)<=3 allowed from ({_DOC}) where char_count<600",
    "run_sheet_segment": rf"""with p as (select packet, row_number() over (partition by packet order by page) page, text from ({_DOC})),
 f as (select *, regexp_matches(text,'(?i)\bthe\b') s, (regexp_matches(text,'(?i)\bthe\b') or contains(text,'|') or regexp_matches(text,'(?i)license')) hit, regexp_matches(text,'(?i)license') div from p where page<=8),
 g as (select *, min(case when s then page end) over (partition by packet) seed from f), h as (select *, row_number() over (partition by packet order by page) nth from g where seed<=3 and page>=seed),
 i as (select *, nth-coalesce(max(case when hit then nth end) over (partition by packet order by page rows between unbounded preceding and current row),0) misses from h),
 j as (select *, coalesce(max((div or misses>=2)::int) over (partition by packet order by page rows between unbounded preceding and 1 preceding),0) done from i),
 k as (select *, coalesce(max(case when done=0 and hit then page end) over (partition by packet),seed) fin from j) select packet, page from k where page<=fin""",
    "shard_pack": f"""with recursive d as (select packet, page, char_count+150 size, row_number() over (partition by packet order by page) n from ({_DOC})),
 r(packet, n, shard, held, sz, out) as (select packet, n, 0, [page], [size], [{{'page':page,'shard':0}}] from d where n=1
 union all select d.packet, d.n, r.shard+f.full::int, case when f.full then list_concat(list_slice(r.held,greatest(len(r.held)-1,1),len(r.held)),[d.page]) else list_append(r.held,d.page) end,
 case when f.full then list_concat(list_slice(r.sz,greatest(len(r.sz)-1,1),len(r.sz)),[d.size]) else list_append(r.sz,d.size) end,
 case when f.full then list_append(list_transform(list_slice(r.held,greatest(len(r.held)-1,1),len(r.held)), lambda x: {{'page':x,'shard':r.shard+1}}),{{'page':d.page,'shard':r.shard+1}}) else [{{'page':d.page,'shard':r.shard}}] end
 from r join d on d.packet=r.packet and d.n=r.n+1, lateral (select len(r.held)>=12 or list_sum(r.sz)+d.size>20000 as full) f)
 select packet, o.page page, o.shard::bigint shard from (select packet, unnest(out) o from r)""",
    "html_page_text": r"select page_id, sha256(trim(regexp_replace(regexp_replace(regexp_replace(html,'(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->',' ','g'),'(?s)<[^>]*>',' ','g'),'[ \t\n\r\f]+',' ','g'))) as text from pages",
    "tsv_line_mean": "with l as (select conv_id, role, count(*) words, sum(length(text))::bigint chars from conversations group by 1,2) select conv_id, count(*) as lines, sum(chars)::bigint chars, round(sum(chars)/sum(words),6) mean from l group by 1",
    "first_accepted_provider": f"select key, min(case when chars>=10 and confidence>=0.5 then ord end) accepted, count(*) attempts from ({_CAND}) group by 1",
    "best_candidate": f"select key, ord, score from (select key, ord, score, row_number() over (partition by key order by score desc, ord) r from (select key, ord, round(confidence+least(0.12::double,chars/20000)+least(0.16::double,signals*0.012::double),6) score from ({_CAND}))) where r=1",
    "evidence_ids": f"select item_id quote_id, 'ev_'||substr(sha256('packet|'||item_id||'|benchmark||'||{_NORM.format(c='text')}),1,20) evidence_id from benchmark",
    "fuzzy_grounding": f"with {_GROUND} select quote_id, page_id, exact, matched, total from found",
    "evidence_state": f"with {_GROUND} select quote_id, case when {_WORDS.format(c='quote')} in {_MISSING} then 'NOT_STATED' when count(page_id)>0 then 'CONFIRMED' else 'UNCONFIRMED' end state, count(page_id) pages from q left join found using(quote_id) group by quote_id, quote",
    "dedup_anchors": f"select page, packet from (select page, packet, row_number() over (partition by {_NORM.format(c='text')} order by page) r from ({_DOC})) where r=1",
    "majority_string": f"select key, value, n from (select *, row_number() over (partition by key order by n desc, length(value) desc, pos) r from (select user_id as key, arg_min(event_type,event_id) as value, count(*) n, min(event_id) pos from events where {_WORDS.format(c='event_type')} not in {_MISSING} group by user_id, {_WORDS.format(c='event_type')})) where r=1",
    "best_fact_tie": f"""with g as (select user_id as key, {_WORDS.format(c="event_type")} norm, min(event_type) as value, count(distinct cast(ts as date)) support, max((event_id%100)/100.0::double) conf from events group by 1,2),
 r as (select *, row_number() over w r, lead(support) over w s2, lead(conf) over w c2 from g window w as (partition by key order by support desc, conf desc, norm))
 select key, case when s2=support and abs(c2-conf)<0.08::double then 'Needs review' else value end as value, support from r where r=1""",
    "merge_instruments": """with v as (select l_orderkey number, 'flag' f, l_returnflag v, l_linenumber p from lineitem union all select l_orderkey, 'qty', cast(cast(l_quantity as int) as varchar), l_linenumber from lineitem),
 b as (select number, f, v, row_number() over (partition by number, f order by count(*) desc, length(v) desc, min(p), v desc) r from v group by 1,2,3)
 select number, max(case when f='flag' then v end) flag, max(case when f='qty' then v end) qty, any_value(n) n from b join (select l_orderkey number, count(*) n from lineitem group by 1) using(number) where r=1 group by 1""",
    "fold_entries": """with r as (select conv_id packet, turn pos, role as key, case when turn%2=0 then '' else text end as value from conversations),
 k as (select packet, key, min(pos) p, coalesce(arg_min(value,pos) filter (value<>''),'') as value from r group by 1,2) select packet, string_agg(key||':'||value,'|' order by p) entries from k group by 1""",
    "reconcile_amounts": f"with {_SUMS} select number, amount::varchar amount, source_amount::varchar source_amount, status from m",
    "reconcile_counts": f"with {_SUMS} select number%10 bucket, sum((status='MATCHED')::int)::bigint matched, sum((status='MISMATCHED')::int)::bigint mismatched, sum((status='SOURCE_MISSING')::int)::bigint missing from m group by 1",
    "omitted_sources": "select o_orderkey number from orders where o_orderkey not in (select l_orderkey from lineitem)",
    "missing_references": "select l_orderkey, l_linenumber::bigint l_linenumber from lineitem where l_partkey not in (select p_partkey from part where p_size<=25)",
    "release_match": """with a as (select o_custkey packet, o_orderkey lien, o_orderkey::varchar number from orders where o_orderstatus='O'), b as (select o_custkey packet, o_orderkey "release", o_orderkey::varchar number, (o_orderkey+1)::varchar refers, 'releases '||(o_orderkey*10) as txt from orders where o_orderstatus='F'),
 m as (select a.packet, lien, "release", case when a.number=refers then 'REFERENCE' when a.number=b.number then 'NUMBER' else 'TEXT' end via, least(case when a.number=refers then 'REFERENCE' else 'Z' end, case when a.number=b.number then 'NUMBER' else 'Z' end, case when contains(txt,a.number) then 'TEXT' else 'Z' end) v from a join b on a.packet=b.packet and (a.number=refers or a.number=b.number or contains(txt,a.number))) select packet, lien, "release", v via from m""",
    "chain_continuity": f"with {_CHAIN} select * from links",
    "chain_by_packet": f"with {_CHAIN} select packet, bool_and(continues) continuous from links group by 1",
    "checks_grounded": "select d.doc_id, case when quality is not null and n_chars<400 then 'CANNOT_CONFIRM' when quality=1 then 'PASS' when quality=0 then 'FAIL' else 'CANNOT_CONFIRM' end status from documents d left join labels l on d.doc_id=l.doc_id",
    "qc_reduce": f"select user_id, day::varchar as day, count(*) n, sum((status='FAIL')::int)::bigint failed, sum((status='CANNOT_CONFIRM')::int)::bigint unresolved, case when bool_or(status='CANNOT_CONFIRM') then 'REVIEW' when bool_or(status='FAIL') then 'FAIL' else 'PASS' end qc_status, case when bool_or(status<>'PASS') then 'Fail' else 'Pass' end pass_fail from ({_CHECKS}) group by user_id, day",
    "qc_issues": f"with checks as ({_CHECKS}), {_META}, {_ISSUES} select packet, code, severity, count(*) n from issues group by 1,2,3",
    "qc_readiness": f"with checks as ({_CHECKS}), {_META}, {_ISSUES} select packet, case when bool_or(severity='BLOCKING' and not unresolved) then 'CURATIVE_REQUIRED' when bool_or(unresolved or severity='REVIEW') then 'REVIEW' else 'QC' end readiness from issues group by 1",
    "accuracy_areas": f"""with checks as ({_CHECKS}), areas(area, check_id) as (values {{areas}})
 select user_id, day::varchar as day, area, case when bool_or(status='FAIL') then 'DISCREPANCIES' when bool_or(status='CANNOT_CONFIRM') then 'INCOMPLETE' when area='CHAIN' then 'COMPLETE' else 'ACCURATE' end status from checks join areas using(check_id) group by 1,2,3""",
    "integrity_guard": """with c as (select source packet, d.doc_id%40 check_id, case when quality=1 then 'PASS' else 'FAIL' end status, n_chars<900 bad from documents d join labels l on d.doc_id=l.doc_id)
 select packet, check_id, case when status='PASS' and bool_and(bad) then 'CANNOT_CONFIRM' else status end status, bool_and(bad) lost from c group by packet, check_id, c.status""",
    "latest_decision": "select user_id, event_type, event_id from (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) r from events) where r=1",
    "decision_overlay": f"""with c as ({_CHECKS}), a as (select user_id, check_id, arg_min(status,event_id) status from c group by 1,2), b as (select user_id, check_id, status decided from (select *, row_number() over (partition by user_id, check_id order by ts desc, event_id desc) r from c) where r=1 and status<>'PASS')
 select a.user_id, a.check_id, a.status, coalesce(decided,a.status) as final, coalesce(decided<>a.status,false) overridden from a left join b on a.user_id=b.user_id and a.check_id=b.check_id""",
    "matter_revision": "with f as (select user_id%40 matter, user_id review, min(ts) first_at from events group by 1,2) select matter, review, row_number() over (partition by matter order by first_at, review) revision from f",
    "identity_keys": f"""with c as (select c_custkey as key, {_WORDS.format(c="c_mktsegment")} scope, c_name, c_nationkey from customer),
 k as (select key, scope, 'order' kind, {_WORDS.format(c="c_name")} v from c where key%3=0 union all select key, scope, 'parcel', c_nationkey::varchar from c where key%4=0 union all select key, scope, 'packet', key::varchar from c where key%3<>0 and key%4<>0)
 select key, kind, kind||'_'||substr(sha256(scope||'|'||kind||'|'||v),1,32) as identity from k""",
    "graph_nodes": "select 'c'||o_custkey id, 'party' as type, arg_min(o_orderpriority,o_orderkey) as label, string_agg(o_orderkey::varchar, ',' order by o_orderkey) evidence from orders group by 1 union all select 'o'||o_orderkey, 'instrument', o_orderstatus, '' from orders",
    "graph_edges": f"with {_EDGES} select src, dst, type, 'edge_'||substr(sha256(src||'|'||type||'|'||dst),1,20) id from e",
    "graph_neighbours": f"with {_EDGES}, s as (select 'o'||o_orderkey seed from orders), n as (select seed, dst other from s join e on seed=src union select seed, src from s join e on seed=dst) select * from (select seed, other, row_number() over (partition by seed order by other) n from n) where n<=4",
    "retrieve_pages": f"""with t as (select item_id question, unnest(list_distinct(list_filter(string_split({_NORM.format(c="text")},' '), lambda x: length(x)>2 and not list_contains(string_split('the and for with from that this what where when does did was were are is has have had who why how can could would should into about title report packet document documents page',' '),x)))) t from benchmark),
 w as (select doc_id page, unnest(string_split({_NORM.format(c="text")},' ')) t from documents), h as (select page, t, count(*) n from w where t in (select t from t) group by 1,2),
 s as (select question, page, sum(least(n,5)*case when length(t)>7 then 2 else 1 end)::bigint score from h join t using(t) group by 1,2)
 select * from (select question, page, score, row_number() over (partition by question order by score desc, page) rank from s) where rank<=12""",
    "citations_verified": f"with {_GROUND} select distinct a.quote_id, a.page_id from (select quote_id, page_id+quote_id%2 page_id from found) a join found b on a.quote_id=b.quote_id and a.page_id=b.page_id",
    "batch_metrics": "select source, count(*) total, sum((quality is not distinct from 1)::int)::bigint clear, sum((quality is not distinct from 0)::int)::bigint curative, sum((quality is null)::int)::bigint review from documents d left join labels l on d.doc_id=l.doc_id group by 1",
    "stage_order": """with s as (select user_id as key, event_id seq, event_id%9+1 i, ['INGEST','EXTRACT','CLASSIFY','NORMALIZE','CHECK','GROUND','RENDER','RECORD','COMPLETE'][event_id%9+1] stage from events),
 l as (select *, coalesce(lag(stage) over (partition by key order by seq),'START') before, coalesce(lag(i) over (partition by key order by seq),0) bi from s) select key, seq, stage, before from l where i<>bi+1""",
    "export_rows": f"""with e as ({_EXPORT}) select key, '"'||replace(owner,'"','""')||'","'||replace(position,'"','""')||'","'||amount||'"' line from e""",
    "export_warnings": f"""with e as ({_EXPORT}), f as (select key, 'owner' field, owner v from e union all select key, 'position', position from e union all select key, 'amount', amount from e) select key, field, 'required field '||field||' is unresolved' message from f where {_WORDS.format(c="v")} in {_MISSING}""",
    "union_except_pages": f"select packet, coalesce(string_agg(page::varchar, ',' order by page) filter (char_count<600 or page%9=0),'') requested, coalesce(string_agg(page::varchar, ',' order by page) filter (page%9=0 and not char_count<600),'') left_over from ({_DOC}) group by 1",
    "scalar_keys": f"select o_orderkey as key, cast(cast(o_totalprice as decimal(18,2)) as varchar) money, strftime(o_orderdate,'%Y-%m-%d') as date, o_orderkey||{_NTH.format(n='o_orderkey')} nth, regexp_replace(upper(o_orderpriority),'[^A-Z0-9]+','','g') alnum, trim(regexp_replace(lower(o_orderpriority),'[^a-z0-9]+','-','g'),'-') slug from orders",
    "page_serializer": f"select packet, sha256(string_agg('[Page '||page||']'||chr(10)||case when text='' then '[UNREADABLE]' else substr(text,1,18000) end, chr(10)||chr(10) order by page)) body from ({_DOC}) group by 1",
}

from docketlab.functions.dimensions import AREAS  # noqa: E402

ORACLES["accuracy_areas"] = ORACLES["accuracy_areas"].replace("{areas}", ",".join(f"('{a}','{c}')" for a, cs in AREAS.items() for c in cs))
