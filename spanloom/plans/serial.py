"""SQL for queries whose rule is serial: recursive common table expressions that follow the rule one step at a time."""

from __future__ import annotations

from spanloom.plans.text import COS, OPEN, SENTENCES
from spanloom.plans.timeline import MEDIA, SCENES
from spanloom.tables import with_tables

ORACLES: dict[str, str] = {}


def recursive(names: str, body: str) -> str:
    return "with recursive" + with_tables(names, body)[len("with") :]


IOU = "greatest(0, least({a}out_ms, {b}out_ms) - greatest({a}in_ms, {b}in_ms)) / cast(({a}out_ms - {a}in_ms) + ({b}out_ms - {b}in_ms) - greatest(0, least({a}out_ms, {b}out_ms) - greatest({a}in_ms, {b}in_ms)) as double)"

# One-to-one merges: verbal candidates in order, each takes its first free visual one.
MERGED = f""", ca as (select a.media_id, a.candidate_id as a_id, a.rank as a_rank, list(b.candidate_id order by b.rank, b.candidate_id) as bs from verbal a join visual b on b.media_id = a.media_id and a.in_ms < b.out_ms and b.in_ms < a.out_ms where {IOU.format(a="a.", b="b.")} >= 0.5 group by 1, 2, 3),
 od as (select *, row_number() over (partition by media_id order by a_rank, a_id) as k from ca),
 gr as (select media_id, k, a_id, bs[1] as pick, [bs[1]] as used from od where k = 1 union all
   select o.media_id, o.k, o.a_id, list_filter(o.bs, lambda x: not list_contains(g.used, x))[1], list_append(g.used, list_filter(o.bs, lambda x: not list_contains(g.used, x))[1]) from gr g join od o on o.media_id = g.media_id and o.k = g.k + 1),
 met as (select a_id, pick as b_id from gr where pick is not null),
 merged as (select a.media_id, a.in_ms, a.out_ms, 'both' as path, a.rank as verbal_rank, b.rank as visual_rank, [a.candidate_id, b.candidate_id] as sources from met join verbal a on a.candidate_id = a_id join visual b on b.candidate_id = b_id
   union all select media_id, in_ms, out_ms, 'verbal', rank, null, [candidate_id] from verbal where candidate_id not in (select a_id from met)
   union all select media_id, in_ms, out_ms, 'visual', null, rank, [candidate_id] from visual where candidate_id not in (select b_id from met))"""
_merge = lambda tail: recursive("verbal visual", MERGED + tail)
_cid = "array_to_string(sources, '+')"
ORACLES["q3_2_merge_candidates"] = _merge(f" select media_id, in_ms, out_ms, path, verbal_rank, visual_rank, {_cid} as sources from merged")
ORACLES["q6_11_to_retrieved"] = _merge(" select media_id, path, in_ms, out_ms, least(verbal_rank, visual_rank) as rank from merged")
ORACLES["q6_12_candidate_priority"] = _merge(" select media_id, path, in_ms, out_ms, row_number() over (partition by media_id order by least(verbal_rank, visual_rank), case when path = 'both' then 0 else 1 end, in_ms, sources[1]) as priority from merged")
ORACLES["q6_14_automatic_selection"] = _merge(f", r as (select media_id, {_cid} as cid, in_ms, out_ms, row_number() over (partition by media_id order by least(verbal_rank, visual_rank), case when path = 'both' then 0 else 1 end, in_ms, {_cid}) as k from merged) select media_id, cid, in_ms, out_ms from r where k = 1")

# Votes: in order of score, a span joins the first leader it matches or becomes one.
VOTES = f""", vo as (select media_id, event_id as candidate_id, event_type as run, in_ms, out_ms, value as score, row_number() over (partition by media_id order by value desc, in_ms, event_id) as k from spans),
 vr as (select media_id, k, [{{'id': candidate_id, 'in_ms': in_ms, 'out_ms': out_ms}}] as leaders, candidate_id, candidate_id as leader_id from vo where k = 1 union all
   select media_id, k, case when hit is null then list_append(leaders, {{'id': candidate_id, 'in_ms': in_ms, 'out_ms': out_ms}}) else leaders end, candidate_id, coalesce(hit, candidate_id) from (
     select v.*, r.leaders, list_filter(r.leaders, lambda x: {IOU.format(a="x.", b="v.")} >= 0.6)[1].id as hit from vr r join vo v on v.media_id = r.media_id and v.k = r.k + 1)),
 vc as (select vo.media_id, leader_id, count(distinct run) as votes, avg(score) as mean_score from vr join vo on vo.candidate_id = vr.candidate_id group by 1, 2 having count(distinct run) >= 2),
 voted as (select vc.media_id, leader_id, vo.in_ms, vo.out_ms, votes, round(mean_score, 6) as mean_score, row_number() over (partition by vc.media_id order by votes desc, round(mean_score, 9) desc, vo.in_ms, leader_id) as rank from vc join vo on vo.candidate_id = leader_id)"""
ORACLES["q6_10_vote_candidate_spans"] = recursive("spans", VOTES + " select * from voted")
#: Spans that a first run did not have: late ones of high value, and all of one bucket of recordings.
LATE_SPANS = "value > 300 or media_id % 16 = 15"
ORACLES["q9_7_cached_votes"] = recursive("spans", VOTES + f", b as (select media_id % 16 as bucket, case when bool_and({LATE_SPANS}) then 'miss' when bool_or({LATE_SPANS}) then 'stale' else 'hit' end as outcome from spans group by 1) select media_id, outcome, leader_id, votes, mean_score, rank from voted join b on b.bucket = media_id % 16")

# Diverse picks: in order of score, refused for the quota, an overlap, the separation or likeness, in this order.
_WORDS = r"list_distinct(list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> ''))"
DIVERSE = f""", dw as (select s.media_id, event_id as candidate_id, in_ms, out_ms, score, coalesce(ws, []) as ws, {{extra}} row_number() over (partition by s.media_id order by score desc, event_id) as place from own s left join (select doc_id, {_WORDS} as ws from documents) d on d.doc_id = s.event_id {{join}}),
 dr as (select media_id, cast(0 as bigint) as place, cast(null as bigint) as candidate_id, cast(null as varchar) as reason, cast([] as {{kind}}[]) as taken from (select distinct media_id from own) union all
   select media_id, place, candidate_id, why, case when why is null then list_append(taken, {{item}}) else taken end from (
     select *, case when len(taken) >= {{quota}} then 'quota' when len(list_filter(taken, lambda x: x.a < out_ms and in_ms < x.z)) > 0 then 'overlap' when len(list_filter(taken, lambda x: greatest(in_ms - x.z, x.a - out_ms) < 15000)) > 0 then 'separation' when len(list_filter(taken, lambda x: {{alike}})) > 0 then 'similar' end as why
     from (select w.*, r.taken from dr r join dw w on w.media_id = r.media_id and w.place = r.place + 1)))"""
_likeness = "coalesce(len(list_intersect(x.ws, ws)) / cast(nullif(len(x.ws) + len(ws) - len(list_intersect(x.ws, ws)), 0) as double) > 0.5, false)"
_plain = DIVERSE.format(extra="", join="", kind="struct(a bigint, z bigint, ws varchar[])", item="{'a': in_ms, 'z': out_ms, 'ws': ws}", quota=8, alike=_likeness)
_own = ", own as (select media_id, event_id, in_ms, out_ms, value as score from spans)"
ORACLES["q6_19_plan_episode"] = recursive("spans", _own + _plain + " select media_id, candidate_id, place, reason is null as selected, reason from dr where place > 0")
ORACLES["q6_20_select_episode"] = recursive("spans", _own + _plain + " select media_id, candidate_id, place from dr where place > 0 and reason is null")
_package = DIVERSE.format(
    extra="vec, view, clear,",
    join="left join (select vec_id, cast(embedding as double[]) as vec from embeddings) v on v.vec_id = s.event_id",
    kind="struct(a bigint, z bigint, ws varchar[], vec double[], view varchar)",
    item="{'a': in_ms, 'z': out_ms, 'ws': ws, 'vec': vec, 'view': view}",
    quota=3,
    alike=f"x.view = view and ({_likeness} or coalesce(list_cosine_similarity(x.vec, vec), 0) > 0.8)",
)
ORACLES["q6_22_episode_package"] = recursive(
    "spans",
    ", ev as (select media_id, event_id, in_ms, out_ms, value / 100 as score, case when event_id % 3 = 0 then 'guest' else 'host' end as view, event_id % 2 = 0 as clear, case when value / 100 < 0.2 then 'low quality' when event_type = 'error' then 'defects' end as gate from spans), own as (select * from ev where gate is null)"
    + _package
    + " select dr.media_id, candidate_id, case when reason is not null then 'rejected' when clear then 'approved' else 'needs review' end as state, reason from dr join own on own.event_id = candidate_id where place > 0 union all select media_id, event_id, 'rejected', gate from ev where gate is not null",
)

# Thinned marks: the next one at least so far from the last.
CUTS = ", cuts as (select distinct media_id, in_ms as cut_ms from spans where event_type = 'error'), media as (select media_id, max(out_ms) as duration_ms from spans group by 1)"
ORACLES["q6_27_detect_shots"] = recursive("spans", CUTS + ", th as (select media_id, min(cut_ms) as cut_ms from cuts group by 1 union all select t.media_id, min(c.cut_ms) from th t join cuts c on c.media_id = t.media_id and c.cut_ms >= t.cut_ms + 401 group by 1) select * from th")
_free = ", fr as (select distinct s.media_id, in_ms as p from spans s join media m on m.media_id = s.media_id where event_type = 'click' and in_ms > 0 and in_ms < duration_ms and not exists (select 1 from cuts c where c.media_id = s.media_id {own} and abs(in_ms - cut_ms) < 1500))"
ORACLES["q5_27_punch_in_schedule"] = recursive("spans", CUTS + _free.format(own="") + ", th as (select media_id, cast(0 as bigint) as p, cast(0 as bigint) as k from media union all select t.media_id, min(f.p), min(k) + 1 from th t join fr f on f.media_id = t.media_id and f.p >= t.p + 3000 group by t.media_id) select media_id, p as at, cast(case when k % 2 = 1 then 1.25 else 1.0 end as double) as zoom from th where k > 0")
ORACLES["q5_28_shot_spans"] = recursive(
    "spans",
    CUTS
    + _free.format(own="and c.cut_ms > 0 and c.cut_ms < duration_ms")
    + """, ev as (select f.media_id, p from fr f join media m on m.media_id = f.media_id where duration_ms - p >= 1000 union select c.media_id, cut_ms from cuts c join media m on m.media_id = c.media_id where cut_ms > 0 and cut_ms < duration_ms and duration_ms - cut_ms >= 1000),
 th as (select media_id, cast(0 as bigint) as p from media union all select t.media_id, min(e.p) from th t join ev e on e.media_id = t.media_id and e.p >= t.p + 3000 group by t.media_id),
 mk as (select * from th union all select media_id, duration_ms from media), sp as (select media_id, p as start_ms, lead(p) over (partition by media_id order by p) as end_ms from mk) select * from sp where end_ms > start_ms""",
)

# Captions and lines, word by word.
_SW = SENTENCES + ", sw as (select media_id, cast(sid as bigint) as sent_id, w, start_ms, end_ms, row_number() over (partition by media_id, sid order by pos) as k from w2)"
ORACLES["q5_37_caption_chunks"] = recursive(
    "words",
    _SW
    + """, cc as (select media_id, sent_id, k, 0 as chunk, 1 as n, length(w) as width, start_ms as b, end_ms as e from sw where k = 1 union all
   select media_id, sent_id, k, chunk + shut::int, case when shut then 1 else n + 1 end, case when shut then length(w) else width + length(w) + 1 end, case when shut then start_ms else b end, end_ms from (
     select s.*, c.chunk, c.n, c.width, c.b, c.n >= 3 or c.width + length(s.w) + 1 > 22 or s.end_ms - c.b > 2000 or s.start_ms - c.e > 400 as shut from cc c join sw s on s.media_id = c.media_id and s.sent_id = c.sent_id and s.k = c.k + 1))
 select media_id, sent_id, cast(max(k) as int) as n_words, cast(max(chunk) + 1 as int) as n_chunks from cc group by 1, 2""",
)
ORACLES["q5_38_wrap_caption_lines"] = recursive(
    "words",
    _SW
    + """, wl as (select media_id, sent_id, k, 1 as n, length(w) as width, length(w) as longest from sw where k = 1 union all
   select media_id, sent_id, k, n + (not fits)::int, case when fits then width + 1 + length(w) else length(w) end, greatest(longest, case when fits then width + 1 + length(w) else length(w) end) from (
     select s.*, c.n, c.width, c.longest, c.width + 1 + length(s.w) <= 32 as fits from wl c join sw s on s.media_id = c.media_id and s.sent_id = c.sent_id and s.k = c.k + 1))
 select media_id, sent_id, cast(max(n) as int) as n_lines, cast(max(longest) as int) as longest from wl group by 1, 2""",
)

# Faces: the largest box, then the best by area over distance from the last pick.
ORACLES["q5_41_choose_face"] = recursive(
    "spans",
    """, bx as (select media_id, in_ms // 100000 * 100000 as at_ms, cast(floor(value) as bigint) % 997 as x, event_id % 90 + 20 as width, event_id % 70 + 20 as height from spans),
 fb as (select media_id, at_ms, row_number() over (partition by media_id order by at_ms) as k, list({'area': width * height, 'x': x, 'width': width, 'height': height, 'c': x + width // 2}) as bs from bx where width * height >= 900 group by 1, 2),
 fa as (select media_id, at_ms, k, p.c as last, p as pick from (select *, list_sort(list_transform(bs, lambda b: {'a': -b.area, 'x': b.x, 'b': b}))[1].b as p from fb where k = 1) union all
   select media_id, at_ms, k, coalesce(p.c, last), p from (select f.media_id, f.at_ms, f.k, a.last, list_sort(list_transform(list_filter(f.bs, lambda b: abs(b.c - a.last) <= 400), lambda b: {'w': -(b.area / cast(1 + abs(b.c - a.last) as double)), 'a': -b.area, 'x': b.x, 'b': b}))[1].b as p from fa a join fb f on f.media_id = a.media_id and f.k = a.k + 1))
 select media_id, at_ms, pick.x as x, pick.width as width, pick.height as height from fa where pick is not null""",
)

# Stories: sentences taken or left out one by one.
ORACLES["q6_25_condense_story"] = recursive(
    "words",
    SENTENCES
    + """, n0 as (select *, string_split(text, ' ') as ws, min(sent_id) over (partition by media_id) as a, max(sent_id) over (partition by media_id) as z, n_words / greatest(0.5, (end_ms - start_ms) / 1000.0) as pace from sent),
 n as (select media_id, sent_id, start_ms, end_ms, end_ms - start_ms as ms, a, z, round(greatest(0.0, least(1.0, cast(0.5 as double) + case when len(list_filter(ws, lambda w: w in ('the', 'um'))) / cast(len(ws) as double) > 0.3 then -0.4 else 0 end + case when ws[-1] in ("""
    + OPEN
    + """) then -0.35 else 0 end
   + case when pace >= 2 then 0.1 when pace < 1 then -0.15 else 0 end + case when sent_id = a then 0.45 when sent_id = z then 0.40 else 0 end)), 6) as importance from n0),
 st as (select media_id, max(case when sent_id = z then end_ms end) - max(case when sent_id = a then start_ms end) as whole, max(case when sent_id = a then ms end) + max(case when sent_id = z then ms end) as ends from n group by 1),
 os as (select n.media_id, sent_id, ms, whole <= 60000 as short, row_number() over (partition by n.media_id order by case when whole <= 60000 then sent_id else 0 end, case when whole <= 60000 then 0 else -importance end, sent_id) as k from n join st on st.media_id = n.media_id where sent_id > a and sent_id < z and (whole > 60000 or importance < 0.35)),
 fo as (select media_id, cast(0 as bigint) as k, cast(null as bigint) as sent_id, case when whole <= 60000 then whole else ends end as total, false as hit from st union all
   select media_id, k, sent_id, case when not ok then total when short then total - ms else total + ms end, ok from (
     select o.*, f.total, case when o.short then f.total - o.ms >= 25000 else f.total + o.ms <= case when f.total < 25000 then 60000 else 50000 end end as ok from fo f join os o on o.media_id = f.media_id and o.k = f.k + 1)),
 kp as (select n.*, whole <= 60000 as short from n join st on st.media_id = n.media_id left join fo on fo.media_id = n.media_id and fo.sent_id = n.sent_id where case when whole <= 60000 then not coalesce(hit, false) else sent_id_in(n.sent_id, a, z) or coalesce(hit, false) end),
 pr as (select *, lag(end_ms) over w as b, lag(sent_id) over w as p, count(*) over (partition by media_id) = z - a + 1 as everything from kp window w as (partition by media_id order by sent_id)),
 sp as (select *, sum(case when p is null then 0 when short then (not everything and sent_id > p + 1)::int else (start_ms - b > 600)::int end) over (partition by media_id order by sent_id) as span from pr)
 select media_id, cast(span as bigint) as span, min(start_ms) as start_ms, max(end_ms) as end_ms, count(*) as n_sentences from sp group by 1, 2""".replace("sent_id_in(n.sent_id, a, z)", "n.sent_id in (a, z)"),
)

# Filler words: marks, then repeats of three, two and one words, leftmost first.
_CLEAN = r"regexp_replace(w, '^[.,!?;:\"''()\[\]…]+|[.,!?;:\"''()\[\]…]+$', '', 'g')"
_FL = "(partition by media_id order by pos)"


def _pass(n: int, before: str) -> str:
    same = " and ".join(f"lead(c, {k}) over {_FL} = lead(c, {n + k}) over {_FL} and not lead(f, {k}) over {_FL}" for k in range(n))
    return f""", ca{n} as (select media_id, pos from (select media_id, pos, coalesce({same} and lead(start_ms, {n}) over {_FL} - lead(end_ms, {n - 1}) over {_FL} between 0 and 3000, false) as t from {before}) where t),
 ch{n} as (select media_id, min(pos) as pos from ca{n} group by 1 union all select h.media_id, min(c.pos) from ch{n} h join ca{n} c on c.media_id = h.media_id and c.pos >= h.pos + {n} group by 1),
 fl{n} as (select b.media_id, b.pos, b.c, b.start_ms, b.end_ms, b.f or exists (select 1 from ch{n} h where h.media_id = b.media_id and h.pos <= b.pos and b.pos < h.pos + {n}) as f from {before} b)"""


ORACLES["q5_8_filler_words"] = recursive(
    "words",
    f", cw as (select media_id, pos, start_ms, end_ms, {_CLEAN} as c from words), fl0 as (select media_id, pos, c, start_ms, end_ms, c in ('um', 'uh', 'the') or coalesce(c = 'of' and lead(c) over {_FL} = 'the', false) or coalesce(c = 'the' and lag(c) over {_FL} = 'of', false) or coalesce(length(c) >= 2 and length(lead(c) over {_FL}) > length(c) and starts_with(lead(c) over {_FL}, c) and lead(start_ms) over {_FL} - end_ms between 0 and 1500, false) as f from cw)"
    + _pass(3, "fl0")
    + _pass(2, "fl3")
    + _pass(1, "fl2")
    + " select media_id, case when bool_and(f) then 0 else count(*) filter (where f) end as n_fillers, count(*) as n_words from fl1 group by 1",
)

# Model stand-ins whose answers are known.
ORACLES["q10_3_reranker_faults"] = "with " + COS + ", h as (select query_id, min(vec_id) as a, max(vec_id) as z from r where rank <= 10 group by 1) select query_id, a as vec_id, 'duplicate' as reason from h union all select query_id, z, 'missing' from h"
ORACLES["q1_33_timeline_json"] = with_tables("verbal", " select media_id, to_json({'name': 'reel', 'tracks': [{'kind': 'video', 'children': list({'name': cast(candidate_id as varchar), 'source_range': {'in_ms': in_ms, 'out_ms': out_ms}, 'markers': 2} order by in_ms, cast(candidate_id as varchar))}]})::varchar as timeline from verbal group by 1")

# Diarization: the best one-to-one mapping of speakers, by trying every one.
_ERROR = """, {n}mk as (select distinct media_id, unnest([start_ms, end_ms]) as s from (select media_id, start_ms, end_ms from {ref} union all select media_id, start_ms, end_ms from {hyp})),
 {n}sl as (select * from (select media_id, s, lead(s) over (partition by media_id order by s) as e from {n}mk) where e is not null),
 {n}ra as (select distinct l.media_id, s, e, speaker from {n}sl l join {ref} t on t.media_id = l.media_id and s < end_ms and start_ms < e), {n}ha as (select distinct l.media_id, s, e, speaker from {n}sl l join {hyp} t on t.media_id = l.media_id and s < end_ms and start_ms < e),
 {n}ct as (select l.media_id, e - s as ms, (select count(*) from {n}ra r where r.media_id = l.media_id and r.s = l.s) as r, (select count(*) from {n}ha h where h.media_id = l.media_id and h.s = l.s) as h from {n}sl l),
 {n}to as (select media_id, sum(ms * r) as speech_ms, sum(ms * greatest(r - h, 0)) as missed_ms, sum(ms * greatest(h - r, 0)) as false_alarm_ms, sum(ms * least(r, h)) as both_ms from {n}ct group by 1),
 {n}mx as (select r.media_id, r.speaker as a, h.speaker as b, sum(r.e - r.s) as ms from {n}ra r join {n}ha h on h.media_id = r.media_id and h.s = r.s group by 1, 2, 3),
 {n}sp as (select media_id, a, row_number() over (partition by media_id order by a) as k from (select distinct media_id, a from {n}mx)),
 {n}tr as (select media_id, cast(0 as bigint) as k, cast([] as varchar[]) as used, cast(0 as bigint) as total from (select distinct media_id from {n}sp) union all
   select t.media_id, s.k, case when m.b is null then t.used else list_append(t.used, m.b) end, cast(t.total + coalesce(m.ms, 0) as bigint) from {n}tr t join {n}sp s on s.media_id = t.media_id and s.k = t.k + 1 join (select media_id, a, b, ms from {n}mx union all select media_id, a, null, null from {n}sp) m on m.media_id = t.media_id and m.a = s.a where m.b is null or not list_contains(t.used, m.b)),
 {n}bt as (select media_id, max(total) as matched from {n}tr group by 1),
 {n}er as (select t.media_id, cast(speech_ms as bigint) as speech_ms, cast(missed_ms as bigint) as missed_ms, cast(false_alarm_ms as bigint) as false_alarm_ms, cast(case when both_ms = 0 then 0 else both_ms - matched end as bigint) as confusion_ms from {n}to t left join {n}bt b on b.media_id = t.media_id)"""
_RATE = "round((missed_ms + false_alarm_ms + confusion_ms) / cast(nullif(speech_ms, 0) as double), 9) as der"
ORACLES["q4_22_diarization_error"] = recursive(
    "turns",
    ", ref as (select media_id, speaker, start_ms, end_ms from turns), hyp as (select media_id, case when turn % 3 = 0 then 's1' else 'x' || speaker end as speaker, start_ms + 300 as start_ms, end_ms + 200 as end_ms from turns where turn % 5 <> 4)" + _ERROR.format(n="d", ref="ref", hyp="hyp") + f" select *, {_RATE} from der",
)
_spans_error = ", ref as (select media_id, event_type as speaker, in_ms as start_ms, out_ms as end_ms from spans), hyp as (select media_id, case when event_type = 'view' then 'click' else event_type end as speaker, in_ms + 500 as start_ms, out_ms as end_ms from spans)" + _ERROR.format(n="d", ref="ref", hyp="hyp")
ORACLES["q4_23_overlap_aware_error"] = recursive("spans", _spans_error + f" select *, {_RATE} from der")
_times = ", ".join(f"cast(sum({c}) as bigint) as {c}" for c in ("speech_ms", "missed_ms", "false_alarm_ms", "confusion_ms"))
ORACLES["q4_24_pooled_error"] = recursive("spans", _spans_error + f", po as (select {_times} from der) select *, {_RATE} from po")
ORACLES["q4_25_diarization_study"] = recursive(
    "turns",
    ", ref as (select media_id, speaker, start_ms, end_ms from turns), late as (select media_id, speaker, start_ms + 300 as start_ms, end_ms + 300 as end_ms from turns), one as (select media_id, 's' as speaker, start_ms, end_ms from turns)"
    + _ERROR.format(n="l", ref="ref", hyp="late")
    + _ERROR.format(n="o", ref="ref", hyp="one")
    + f", every as (select 'late' as system, * from ler union all select 'one', * from oer), po as (select system, cast(null as bigint) as media_id, {_times} from every group by 1) select *, {_RATE} from every union all select *, {_RATE} from po",
)

# Windows read by a stand-in, and what is known of each stretch of a recording.
ORACLES["q6_8_discover_visual"] = with_tables(
    "spans",
    SCENES + ", sc2 as (select media_id, media_id || ':s' || scene || ':w' || \"window\" as window_id, in_ms, in_ms % 5 = 0 as refused from win), rk as (select media_id, window_id, cast(in_ms % 97 as double) as score, row_number() over (partition by media_id order by in_ms % 97 desc, in_ms, window_id) as rank, cast(null as varchar) as reason from sc2 where not refused) select * from rk union all select media_id, window_id, null, null, 'refused' from sc2 where refused",
)
_INVENTORY = (
    MEDIA
    + """, me as (select media_id, duration_ms, cast(floor(duration_ms * 3 / 4) as bigint) as scan_out from media), iv as (select s.media_id, event_type, in_ms as a, out_ms as z, duration_ms from spans s join me on me.media_id = s.media_id where event_type in ('view', 'signup')),
 pk as (select distinct media_id, p from (select media_id, unnest([0, duration_ms, scan_out]) as p from me union all select c.media_id, cut_ms from cuts c join me on me.media_id = c.media_id where cut_ms > 0 and cut_ms < duration_ms union all select media_id, unnest([greatest(0, least(a, duration_ms)), greatest(0, least(z, duration_ms))]) from iv)),
 sl as (select * from (select media_id, p as a, lead(p) over (partition by media_id order by p) as z from pk) where z is not null),
 fl as (select sl.media_id, sl.a, sl.z, exists (select 1 from iv where iv.media_id = sl.media_id and event_type = 'view' and iv.a < sl.z and sl.a < iv.z) as sp, exists (select 1 from iv where iv.media_id = sl.media_id and event_type = 'signup' and iv.a < sl.z and sl.a < iv.z) as ins,
   (select count(*) from spans f where f.media_id = sl.media_id and f.event_type = 'purchase' and sl.a <= f.in_ms and f.in_ms < sl.z) as n, scan_out from sl join me on me.media_id = sl.media_id),
 lv as (select *, case when ins then 'inspected' when n > 0 then 'sampled' when z <= scan_out then 'scanned' else 'unknown' end as level from fl),
 nb as (select *, case when ins then 0 else n end as f from lv), gp as (select *, (coalesce(level <> lag(level) over w or sp <> lag(sp) over w or f <> lag(f) over w, true))::int as fresh from nb window w as (partition by media_id order by a)),
 gi as (select *, sum(fresh) over (partition by media_id order by a) as i from gp), inv as (select media_id, i, level, sp as has_speech, min(a) as in_ms, max(z) as out_ms from gi group by 1, 2, 3, 4)"""
)
ORACLES["q5_33_observation_inventory"] = with_tables("spans", _INVENTORY + " select media_id, in_ms, out_ms, level, has_speech from inv")
ORACLES["q4_44_coverage_summary"] = with_tables("spans", _INVENTORY + ", cs as (select media_id, level, cast(sum(out_ms - in_ms) as bigint) as ms, cast(sum(case when has_speech then out_ms - in_ms else 0 end) as bigint) as speech_ms from inv group by 1, 2) select *, round(ms / cast(sum(ms) over (partition by media_id) as double), 6) as share from cs")
_frames = ", al as (select media_id, in_ms, out_ms, case when event_type = 'error' then 0 else least(4, greatest(1, (out_ms - in_ms) // 20000)) end as want, row_number() over (partition by media_id order by value desc, in_ms, out_ms, event_id) as k from spans), lt as (select *, cast(least(want, greatest(40 - coalesce(sum(want) over (partition by media_id order by k rows between unbounded preceding and 1 preceding), 0), 0)) as bigint) as frames from al), fr as (select media_id, case when frames = 1 then in_ms + (out_ms - in_ms) // 2 else cast(round_even(in_ms + i * ((out_ms - in_ms) / cast(frames + 1 as double)), 0) as bigint) end as at_ms from (select *, unnest(range(1, frames + 1)) as i from lt))"
_applied = _INVENTORY.replace("from spans f where f.media_id = sl.media_id and f.event_type = 'purchase' and sl.a <= f.in_ms and f.in_ms < sl.z", "from fr f where f.media_id = sl.media_id and sl.a <= f.at_ms and f.at_ms < sl.z").replace("cast(floor(duration_ms * 3 / 4) as bigint) as scan_out", "duration_ms as scan_out")
ORACLES["q5_36_apply_observation"] = with_tables("spans", _frames + _applied + " select media_id, in_ms, out_ms, level, has_speech from inv")

# Splits: what an episode reaches over speakers is one component.
ORACLES["q7_5_partition_disjoint"] = recursive(
    "spans",
    """, g as (select event_id, media_id as episode, media_id // 3 + (value > 200)::int as speaker from spans), ed as (select distinct 'e' || episode as u, 's' || speaker as v from g), bw as (select u, v from ed union all select v, u from ed),
 rc as (select distinct u, u as v from bw union select rc.u, bw.v from rc join bw on bw.u = rc.v), cm as (select u, min(v) as c from rc group by 1),
 rw as (select g.*, c from g join cm on u = 'e' || episode), sz as (select c, count(*) as n, min(cast(episode as varchar)) as name from rw group by 1),
 pl as (select c, n, coalesce(sum(n) over (order by sha256('disjoint:' || name), c rows between unbounded preceding and 1 preceding), 0) as b, sum(n) over () as total from sz)
 select event_id, episode, speaker, case when b = 0 or (b < greatest(1, round(total * 0.2)) and b + n <= total - 1) then 'holdout' else 'training' end as split from rw join pl on pl.c = rw.c""",
)
