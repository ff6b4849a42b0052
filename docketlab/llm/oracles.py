"""SQL twins of the training-data queries that SQL can express (checked with DuckDB)."""

MIXING = """with s as (select doc_id, source, coalesce(len(regexp_extract_all(text,'[^\\x20\\x09-\\x0D]+')),0)::bigint size, ('0x'||substr(md5(coalesce(doc_id::varchar,'')),1,15))::bigint hash from documents),
 per as (select source, sum(size)::bigint source_size, row_number() over (order by source nulls last) rank from s group by source),
 w as (select *, ((rank-1)%3+1)::double weight, source_size*3.0::double roof from per),
 l as (select *, (sum(source_size) over () - coalesce(sum(roof) over o,0))/(sum(weight) over () - coalesce(sum(weight) over o,0)) level, roof/weight ratio, row_number() over (order by roof/weight, rank) n from w window o as (order by roof/weight, rank rows between unbounded preceding and 1 preceding)),
 t as (select source, source_size, least(roof, (select arg_min(level,n) from l where level<=ratio)*weight) target from l),
 p as (select *, case when source_size>0 then floor(target/source_size)::int else 0 end passes from t),
 c as (select s.*, source_size, target, passes, target-passes*source_size need, sum(size) over (partition by s.source order by hash range unbounded preceding) upto, sum(size) over (partition by s.source, hash) own from s join p on s.source is not distinct from p.source)
 select doc_id, size, source_size, target, (size*(passes + case when need<=0 or upto-own>=need then 0 when upto<need then 1 when upto-need<=need-(upto-own) then 1 else 0 end))::bigint taken from c"""

LINES = """with l as (select doc_id, unnest(string_split(text,chr(10))) line, generate_subscripts(string_split(text,chr(10)),1) pos from documents),
 f as (select line, min((doc_id,pos)) first, length(line) n from l where regexp_matches(line,'[^\\x20\\x09-\\x0D]') group by line),
 near as (select distinct a.line from f a join f b on a.n>=32 and b.n>=32 and a.n between b.n-2 and b.n+2 and b.first<a.first and levenshtein(a.line,b.line)<=2),
 d as (select l.*, near.line is not null is_near, coalesce(near.line is not null or (doc_id,pos)>f.first,false) gone from l left join f on l.line=f.line left join near on l.line=near.line)
 select doc_id, count(*)::int n_lines, sum(gone::int)::int n_dropped, sum((gone and is_near)::int)::int n_near, length(coalesce(string_agg(line,chr(10) order by pos) filter (not gone),''))::bigint kept_chars, sha256(coalesce(string_agg(line,chr(10) order by pos) filter (not gone),'')) kept_sha256 from d group by doc_id"""

SHINGLES = """with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'),'[^\\x20\\x09-\\x0D]+') w from documents),
 g as (select doc_id, unnest(list_distinct(case when len(w)=0 then [] when len(w)<5 then [array_to_string(w,' ')] else list_transform(range(1,len(w)-3), lambda i: array_to_string(list_slice(w,i,i+4),' ')) end)) s from w),
 n as (select doc_id, count(*) n from g group by 1),
 pr as (select a.doc_id a, b.doc_id b, count(*) c from g a join g b on a.s=b.s and a.doc_id<b.doc_id group by 1,2),
 e as (select a, b from pr join n x on x.doc_id=a join n y on y.doc_id=b where 100*c>=80*(x.n+y.n-c)),
 b as (select a, b from e union all select b, a from e),
 r(doc_id, c) as (select distinct a, a from b union select r.doc_id, b.b from r join b on r.c=b.a)
 select d.doc_id, coalesce(n.n,0)::bigint n_shingles, coalesce(m.c,d.doc_id) component_id from documents d left join n on d.doc_id=n.doc_id left join (select doc_id, min(c) c from r group by 1) m on d.doc_id=m.doc_id"""

#: crc32 byte by byte and bit by bit; a node is the list of its turns.
TRIE = """with t as (select conv_id, {'r': coalesce(role,''), 't': coalesce(text,'')} turn, row_number() over (partition by conv_id order by turn nulls first, sha256(length(coalesce(role,''))::varchar||':'||coalesce(role,'')||coalesce(text,''))) i from conversations where conv_id is not null),
 own as (select conv_id, list(turn order by i) turns from t group by conv_id),
 h as (select *, conv_id - conv_id%20 base, xor(list_reduce(list_prepend(4294967295::ubigint, list_transform(range(1, length(conv_id::varchar)+1), lambda i: ascii(substr(conv_id::varchar,i::int,1))::ubigint)), lambda c, b: list_reduce(list_prepend(xor(c,b), list_transform(range(8), lambda z: 0::ubigint)), lambda x, z: case when x & 1::ubigint = 1 then xor(x >> 1::ubigint, 3988292384::ubigint) else x >> 1::ubigint end)), 4294967295::ubigint) % 4 h from own),
 r as (select a.conv_id, case when a.conv_id=a.base then a.turns else list_concat(coalesce(list_slice(b.turns,1,a.h::int),[]), list_slice(a.turns,a.h::int+1,len(a.turns))) end turns from h a left join own b on b.conv_id=a.base),
 m as (select conv_id, len(turns)=d is_end, d depth, case when d=0 then [] else list_slice(turns,1,d) end path from (select *, unnest(range(0,len(turns)+1)) d from r)),
 n as (select path, any_value(depth) depth, min(conv_id) conv_id, count(*) n_convs, sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (is_end),'')) ends_sha256, (count(*)-1)*case when any_value(depth)=0 then 0 else len(regexp_extract_all(list_extract(path,-1).t,'[^\\x20\\x09-\\x0D]+')) end saved from m group by path),
 k as (select list_slice(path,1,depth-1) path, count(*) n from n where depth>0 group by 1),
 s as (select case when d=0 then [] else list_slice(path,1,d) end path, sum(saved) saved, sum(leaf) leaves from (select n.*, (k.n is null)::int leaf, unnest(range(0,depth+1)) d from n left join k on n.path=k.path) group by 1)
 select n.conv_id, n.depth, p.conv_id parent_conv_id, n.n_convs, coalesce(k.n,0) n_children, s.leaves::bigint n_leaves, s.saved::bigint saved_tokens, n.ends_sha256 from n join s on s.path=n.path left join k on k.path=n.path left join n p on n.depth>0 and p.path=(case when n.depth=1 then [] else list_slice(n.path,1,n.depth-1) end)"""

ORACLES = {"op12_prefix_trie": TRIE, "op2_line_dedup": LINES, "op7_ngram_jaccard": SHINGLES, "op9_mixing": MIXING}
