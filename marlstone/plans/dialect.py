"""The few places where the SQL of Spark and that of the checking engine differ."""


class Spark:
    nl, null_safe, day = "'\\n'", "<=>", "to_date"
    table = staticmethod(lambda name: "{" + name + "}")
    words = staticmethod(lambda x: f"cast(regexp_count(translate({x}, '\\u001c\\u001d\\u001e\\u001f\\u0085\\u00a0\\u1680\\u2000\\u2001\\u2002\\u2003\\u2004\\u2005\\u2006\\u2007\\u2008\\u2009\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000', '{' ' * 23}'), '\\\\S+') as bigint)")
    bytes = staticmethod(lambda x: f"octet_length({x})")
    sha1_blob = staticmethod(lambda x: f"sha1(concat(encode(concat('blob ', octet_length({x})), 'utf-8'), X'00', encode({x}, 'utf-8')))")
    sha256 = staticmethod(lambda x: f"sha2({x}, 256)")
    replace_all = staticmethod(lambda x, p, to: f"regexp_replace({x}, '{p.replace(chr(92), chr(92) * 2)}', '{to}')")
    extract = staticmethod(lambda x, p, g: f"regexp_extract({x}, '{p.replace(chr(92), chr(92) * 2)}', {g})")
    extract_all = staticmethod(lambda x, p, g: f"explode(regexp_extract_all({x}, '{p.replace(chr(92), chr(92) * 2)}', {g}))")
    matches = staticmethod(lambda x, p: f"{x} rlike '{p.replace(chr(92), chr(92) * 2)}'")
    lines = staticmethod(lambda t, key, text: f"(select {key}, cast(pos + 1 as bigint) as lineno, line from {t} lateral view posexplode(split({text}, '\\n', -1)) x as pos, line)")
    joined = staticmethod(lambda order, x, sep: f"array_join(transform(array_sort(collect_list(struct({order} as o, {x} as x))), s -> s.x), {sep})")
    json_long = staticmethod(lambda x, k: f"cast(get_json_object({x}, '$.{k}') as bigint)")
    day_of = staticmethod(lambda x: f"to_date({x})")
    last_before = staticmethod(lambda x, part, order: f"last_value({x}) ignore nulls over (partition by {part} order by {order} rows between unbounded preceding and 1 preceding)")
    recursive = "with recursive"
    seconds = staticmethod(lambda x: f"cast(rint(unix_micros(cast({x} as timestamp)) / 1e6) as bigint)")  # whole seconds to the nearest, halves to even
    ord_day = staticmethod(lambda x: f"date_format({x}, 'yyyy-MM-dd')")
    max_by = staticmethod(lambda x, o: f"max_by({x}, {o})")
    week_days = staticmethod(lambda a, b: f"explode(sequence(date_trunc('week', {a}), cast({b} as timestamp), interval 7 days))")
    week = staticmethod(lambda x: f"weekofyear({x})")


class Duck:
    nl, null_safe = "chr(10)", "IS NOT DISTINCT FROM"
    table = staticmethod(lambda name: name)
    words = staticmethod(lambda x: f"len(regexp_extract_all({x}, '[^\\t-\\r\\x1c- \\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+'))")
    bytes = staticmethod(lambda x: f"strlen({x})")
    sha1_blob = staticmethod(lambda x: f"sha1(encode('blob ' || strlen({x})) || '\\x00'::blob || encode({x}))")
    sha256 = staticmethod(lambda x: f"sha256({x})")
    replace_all = staticmethod(lambda x, p, to: f"regexp_replace({x}, '{p}', '{to}', 'g')")
    extract = staticmethod(lambda x, p, g: f"regexp_extract({x}, '{p}', {g})")
    extract_all = staticmethod(lambda x, p, g: f"unnest(regexp_extract_all({x}, '{p}', {g}))")
    matches = staticmethod(lambda x, p: f"regexp_matches({x}, '{p}')")
    lines = staticmethod(lambda t, key, text: f"(select {key}, unnest(range(1, len(l) + 1)) as lineno, unnest(l) as line from (select {key}, string_split({text}, chr(10)) as l from {t}))")
    joined = staticmethod(lambda order, x, sep: f"string_agg({x}, {sep} order by {order})")
    json_long = staticmethod(lambda x, k: f"cast(json_extract_string({x}, '$.{k}') as bigint)")
    day_of = staticmethod(lambda x: f"cast({x} as date)")
    last_before = staticmethod(lambda x, part, order: f"last_value({x} ignore nulls) over (partition by {part} order by {order} rows between unbounded preceding and 1 preceding)")
    recursive = "with recursive"
    seconds = staticmethod(lambda x: f"cast(epoch({x}) as bigint)")
    ord_day = staticmethod(lambda x: f"strftime({x}, '%Y-%m-%d')")
    max_by = staticmethod(lambda x, o: f"max_by({x}, {o})")
    week_days = staticmethod(lambda a, b: f"unnest(generate_series(date_trunc('week', {a}), cast({b} as timestamp), interval 7 days))")
    week = staticmethod(lambda x: f"cast(weekofyear({x}) as integer)")
