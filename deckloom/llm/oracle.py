"""DuckDB SQL for the queries that SQL can express."""



def vector_codes_sql(rounds: int = 2) -> str:
    """Codebooks round by round, each part held against all entries."""
    ctes = [
        """v as (select row_number() over () as r, vec_id, label, [floor(256 * x::double)::bigint for x in embedding] as q from embeddings
           where embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0)""",
        "p as (select r, k, q[k * len(q) // 16 + 1 : (k + 1) * len(q) // 16] as q from v, range(16) as g(k))",
        "b0 as (select k, row_number() over (partition by k order by vec_id) - 1 as e, q as c from p join v using (r) qualify row_number() over (partition by k order by vec_id) <= 64)".replace("q as c", "p.q as c"),
    ]
    for i in range(rounds + 1):
        ctes.append(f"d{i} as (select r, p.k, e, list_sum([(x[1] - x[2]) ** 2 for x in list_zip(q, c)])::bigint as d from p join b{i} b on p.k = b.k)")
        ctes.append(f"a{i} as (select r, k, min(d) as d, min(e) filter (d = m) as e from (select *, min(d) over (partition by r, k) as m from d{i}) group by r, k)")
        if i < rounds:
            ctes.append(f"s{i} as (select k, e, j, sum(q[j])::bigint as s, count(*) as n from (select a.k, a.e, p.q, unnest(range(1, len(p.q) + 1)) as j from a{i} a join p on a.r = p.r and a.k = p.k) group by k, e, j)")
            ctes.append(f"m{i} as (select k, e, list(floor(s / n)::bigint order by j) as c from s{i} group by k, e)")
            ctes.append(f"b{i + 1} as (select b.k, b.e, coalesce(m.c, b.c) as c from b{i} b left join m{i} m on b.k = m.k and b.e = m.e)")
    ctes.append(f"z as (select sha256(string_agg(array_to_string(c, ','), ',' order by k, e)) as h from b{rounds})")
    ctes.append(f"t as (select r, string_agg(lpad(lower(to_hex(e)), 2, '0'), '' order by k) as code, sum(d)::bigint as error from a{rounds} group by r)")
    return f"""with {", ".join(ctes)}
        select vec_id, code, error, sum(error) over (partition by label)::bigint as label_error, h as codebooks_sha256 from t join v using (r), z"""


SQL = {
    "op1_exact_dedup": r"""
        with t as (select doc_id, length(coalesce(text, '')) as n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as norm from documents)
        select doc_id, first_value(doc_id) over w as keep_id, count(*) over (partition by norm) as group_size,
               doc_id = first_value(doc_id) over w as kept, sha256(norm) as text_sha256
        from t window w as (partition by norm order by n desc, doc_id)
    """,
    "op3_warc": r"""
        with p as (select coalesce(page_id::varchar, '') as id, coalesce(url, '') as url, coalesce(html, '') as html, chr(13) || chr(10) as nl from pages),
        h as (select *, 'HTTP/1.1 200 OK' || nl || 'Content-Type: text/html; charset=utf-8' || nl || 'Content-Length: ' || strlen(html) as head, md5('8:response' || strlen(id) || ':' || id || strlen(url) || ':' || url || '64:' || sha256(html)) as u from p),
        r as (select *, '<urn:uuid:' || u[1:8] || '-' || u[9:12] || '-' || u[13:16] || '-' || u[17:20] || '-' || u[21:32] || '>' as rid, 'sha256:' || sha256(html) as pd,
                     'sha256:' || sha256(head || nl || nl || html) as bd, len(regexp_extract_all(html, '(?i)<a\s[^>]*href')) as links,
                     regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>', ' ', 'g'), '(?is)<style\b.*?</style\s*>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g') as bare from h),
        e as (select *, replace(replace(replace(replace(regexp_replace(bare, '<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"') as half from r),
        t as (select *, trim(regexp_replace(replace(replace(replace(replace(half, '&#39;', chr(39)), '&copy;', chr(169)), '&middot;', chr(183)), '&amp;', '&'), '[ \t\r\n\x0B\f]+', ' ', 'g'), ' ') as plain from e),
        o as (select 'metadata' as record_type, 'application/warc-fields' as content_type, rid, url, pd, head,
                     'source-payload-digest: ' || pd || nl || 'source-block-digest: ' || bd || nl || 'outlinks: ' || links || nl || 'source-http: ' || replace(head, nl, nl || 'source-http: ') || nl as out from t
              union all select 'conversion', 'text/plain; charset=utf-8', rid, url, pd, head, plain from t),
        i as (select *, md5(strlen(record_type) || ':' || record_type || strlen(rid) || ':' || rid) as u from o)
        select record_type, '<urn:uuid:' || u[1:8] || '-' || u[9:12] || '-' || u[13:16] || '-' || u[17:20] || '-' || u[21:32] || '>' as record_id, rid as refers_to, url as target_uri, content_type,
               strlen(out) as content_length, 'sha256:' || sha256(out) as block_digest, pd as payload_digest, head as source_headers from i
    """,
    "op7_line_dedup": r"""
        with d as (select row_number() over () as r, doc_id, coalesce(source, '') as site, text from documents),
        l as (select r, site, unnest(range(1, len(string_split(text, chr(10))) + 1)) as pos, unnest(string_split(text, chr(10))) as line from d),
        k as (select r, site, pos, line, md5(trim(line, E' \t\x0b\x0c\r')) as key, trim(line, E' \t\x0b\x0c\r') = '' as blank from l),
        s as (select r, list_sort(list(distinct key)) as keys from k where not blank group by r),
        o as (select distinct k.r, site, key, case when key = keys[1] then coalesce(keys[2], '') else keys[1] end as other from k join s on k.r = s.r where not blank),
        bad as (select key from o group by key having count(distinct site) >= 10 and 2 * count(distinct other) >= count(*)),
        n as (select r, count(*) as n_lines, count(bad.key) as n_removed, string_agg(case when bad.key is null then line end, chr(10) order by pos) as kept
              from k left join bad on k.key = bad.key and not blank group by r)
        select doc_id, coalesce(n_lines, 0) as n_lines, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as text_sha256 from d left join n on d.r = n.r
    """,
    "op8_decontaminate": r"""
        with w as (select row_number() over () as r, doc_id,
                          regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents),
        b as (select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from benchmark),
        bw as (select item_id, least(len(ws), 13) as m, ws, unnest(range(1, len(ws) - least(len(ws), 13) + 2)) as i from b where len(ws) > 0),
        p as (select distinct item_id, m, array_to_string(ws[i : i + m - 1], ' ') as win from bw),
        dw as (select r, m, i, array_to_string(ws[i : i + m - 1], ' ') as win
               from (select r, m, ws, unnest(range(1, len(ws) - m + 2)) as i from w, (select distinct m from p) where len(ws) >= m)),
        hit as (select dw.r, dw.i, dw.m, p.item_id from dw join p on dw.m = p.m and dw.win = p.win),
        wd as (select r, count(distinct x) as n_hit from (select r, unnest(range(i, i + m)) as x from (select distinct r, i, m from hit)) group by r),
        it as (select r, count(distinct item_id) as n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as ids from hit group by r)
        select doc_id, coalesce(len(ws), 0) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256,
               coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= coalesce(len(ws), 0) as contaminated
        from w left join wd on w.r = wd.r left join it on w.r = it.r
    """,
    "op12_fill_middle": r"""
        with d as (select doc_id, coalesce(text, '') as t, sha256('1:' || coalesce(doc_id::varchar, '')) as s from documents),
        u as (select *, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') as us, ('0x' || s[1:8])::bigint as h1, ('0x' || s[9:16])::bigint as h2, ('0x' || s[17:24])::bigint as h3, ('0x' || s[25:32])::bigint as h4 from d),
        c as (select *, len(us) as n, least(h1 % (len(us) + 1), h2 % (len(us) + 1)) as a, greatest(h1 % (len(us) + 1), h2 % (len(us) + 1)) as b,
                     case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form from u),
        p as (select *, array_to_string(us[1:a], '') as pre, array_to_string(us[a + 1:b], '') as mid, array_to_string(us[b + 1:], '') as suf from c)
        select doc_id, n, form, case when form <> 'plain' then length(pre) end as prefix_chars, case when form <> 'plain' then length(mid) end as middle_chars,
               sha256(case form when 'plain' then t when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid else '<S>' || suf || '<P>' || pre || '<M>' || mid end) as output_sha256, sha256(t) as restored_sha256
        from p
    """,
    "op13_vector_codes": vector_codes_sql(),
}
