"""Composite reorder features."""

from pyspark.sql import functions as F

from tessera.catalog.base import query
from tessera.catalog.views import basket_lines, basket_orders, basket_sql
from tessera.operators.frames import rounded
from tessera.plans import basket as B
from tessera.session import TASK_ROWS, cut_by_user, cut_lineage


def both(t):
    """Orders and lines as written tables, as the features read them many times."""
    orders = cut_lineage(basket_orders(t))
    return orders, cut_lineage(basket_lines(t, orders))


def both_by_user(t):
    """Orders and lines written by user and the number of files of each; without it if one user has very many orders."""
    largest = t.orders.where("o_custkey is not null").groupBy("o_custkey").count().agg(F.max("count")).first()[0] or 0
    if largest > TASK_ROWS:
        return *both(t), None
    parts = max(int(t.spark.conf.get("spark.sql.shuffle.partitions")), -(-t.lineitem.count() // TASK_ROWS))
    orders = cut_by_user(basket_orders(t, parts), parts)
    return orders, cut_by_user(basket_lines(t, orders, parts), parts), parts


def prior(t):
    orders, lines = both(t)
    return orders.where("eval_set = 'prior'"), lines.where("eval_set = 'prior'")


def prior_lines(t, *columns):
    """The prior lines alone, with the columns a feature reads."""
    return cut_lineage(basket_lines(t).where("eval_set = 'prior'").select(*columns))


def product_sql(src, p="prod_", extra=True):
    more = f""", count(*) FILTER (again > 0) AS {p}users_reordered,
      round(avg(CASE WHEN again > 0 THEN 1.0 ELSE 0.0 END), 6) AS {p}reorder_prob, round(any_value(cm), 6) AS {p}cart_mean""" if extra else ""
    return f"""SELECT product_id, CAST(sum(times) AS BIGINT) AS {p}orders, count(*) AS {p}user,
      CAST(sum(again) AS BIGINT) AS {p}reorders,
      round(count(*) FILTER (times >= 2) / count(*), 6) AS {p}reorder_probability,
      round(1 + sum(again) / count(*), 6) AS {p}reorder_times,
      round(sum(again) / sum(times), 6) AS {p}reorder_ratio {more}
    FROM (SELECT user_id, product_id, count(*) times, sum(reordered) again FROM {src} GROUP BY ALL)
    {f'JOIN (SELECT product_id, avg(cart_pos) cm FROM {src} GROUP BY 1) USING (product_id)' if extra else ''}
    GROUP BY product_id"""


def mode_sql(src, keys, value, out):
    k = ", ".join(keys)
    return f"""(SELECT {k}, {value} AS {out} FROM (SELECT {k}, {value}, row_number() OVER (PARTITION BY {k}
      ORDER BY count(*) DESC, {value}) r FROM {src} GROUP BY {k}, {value}) WHERE r = 1)"""


def user_sql(o, l, p="user_"):
    return f"""SELECT user_id, {p}orders, {p}period, round({p}mean_days_since_prior, 6) AS {p}mean_days_since_prior,
      {p}median_days_since_prior, round({p}sd_days_since_prior, 6) AS {p}sd_days_since_prior,
      {p}total_products, round({p}mean_order_size, 6) AS {p}mean_order_size,
      round({p}reorder_ratio, 6) AS {p}reorder_ratio, {p}distinct_products, {p}median_basket, {p}mode_hour, {p}mode_dow,
      round({p}total_products / {p}orders, 6) AS {p}average_basket
    FROM (SELECT user_id, max(order_number) AS {p}orders, CAST(coalesce(sum(days_since_prior), 0) AS BIGINT) AS {p}period,
        avg(days_since_prior) AS {p}mean_days_since_prior, median(days_since_prior) AS {p}median_days_since_prior,
        var_samp(days_since_prior) AS {p}sd_days_since_prior FROM {o} GROUP BY 1)
    JOIN (SELECT user_id, count(*) AS {p}total_products,
        sum(reordered) / nullif(count(*) FILTER (order_number > 1), 0) AS {p}reorder_ratio,
        count(DISTINCT product_id) AS {p}distinct_products, count(DISTINCT department_id) AS {p}median_basket
        FROM {l} GROUP BY 1) USING (user_id)
    JOIN (SELECT user_id, avg(n) AS {p}mean_order_size FROM (SELECT user_id, order_id, count(*) n FROM {l} GROUP BY ALL)
        GROUP BY 1) USING (user_id)
    JOIN {mode_sql(o, ['user_id'], 'order_hour', p + 'mode_hour')} USING (user_id)
    JOIN {mode_sql(o, ['user_id'], 'order_dow', p + 'mode_dow')} USING (user_id)"""


def group_sql(l, g, p):
    return f"""SELECT user_id, {g}, count(*) AS {p}_product, CAST(sum(reordered) AS BIGINT) AS {p}_reorder,
      count(DISTINCT order_id) AS {p}_orders, round(avg(cart_pos), 6) AS {p}_add_to_cart,
      round(sum(reordered) / count(DISTINCT order_id), 6) AS {p}_reorder_ratio FROM {l} GROUP BY ALL"""


def up_sql(lines, orders):
    return f"""SELECT user_id, product_id, up_orders, up_first_order, up_last_order,
  round(up_mean_cart_position, 6) AS up_mean_cart_position, up_median_cart_position,
  round(up_inverted_mean, 6) AS up_inverted_mean, up_inverted_median, round(up_relative_mean, 6) AS up_relative_mean,
  round(up_hour_mean, 6) AS up_hour_mean, round(up_dow_mean, 6) AS up_dow_mean, round(up_days_mean, 6) AS up_days_mean,
  round(re / up_orders, 6) AS up_reorder_rate, round((re + 1.0) / up_orders, 6) AS up_reordered_ratio, up_se_last_order,
  round(up_orders / user_orders, 6) AS up_order_rate, user_orders - up_last_order AS up_orders_since_last_order,
  round(up_orders / (user_orders + 1 - up_first_order), 6) AS up_order_rate_since_first_order,
  up_last_order - up_se_last_order AS up_orders_since_se_last_order,
  round(up_orders / (user_orders + 1 - up_se_last_order), 6) AS up_order_rate_since_se_first_order
FROM (SELECT user_id, product_id, count(*) AS up_orders, min(order_number) AS up_first_order, max(order_number) AS up_last_order,
    avg(cart_pos) AS up_mean_cart_position, median(cart_pos) AS up_median_cart_position,
    avg(size - cart_pos) AS up_inverted_mean, median(size - cart_pos) AS up_inverted_median,
    avg(cart_pos / size) AS up_relative_mean, avg(order_hour) AS up_hour_mean, avg(order_dow) AS up_dow_mean,
    avg(days_since_prior) AS up_days_mean, sum(reordered) AS re
  FROM {lines} JOIN (SELECT order_id, count(*) size FROM {lines} GROUP BY 1) USING (order_id) GROUP BY ALL)
JOIN (SELECT user_id, product_id, coalesce(max(CASE WHEN r = 2 THEN order_number END), 0) AS up_se_last_order
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id, product_id ORDER BY order_number DESC) r
    FROM (SELECT DISTINCT user_id, product_id, order_number FROM {lines})) GROUP BY ALL) USING (user_id, product_id)
JOIN (SELECT user_id, max(order_number) AS user_orders FROM {orders} GROUP BY 1) USING (user_id)"""


UP_SQL = up_sql("prior", "(SELECT * FROM ord WHERE eval_set = 'prior')")


@query("f01_product_features", basket_sql(product_sql("prior")))
def _(t):
    return rounded(B.product_features(prior(t)[1]))


@query("f02_user_features", basket_sql(user_sql("po", "prior"), "po AS (SELECT * FROM ord WHERE eval_set = 'prior')"))
def _(t):
    return rounded(B.user_features(*prior(t)))


@query("f03_user_aisle", basket_sql(group_sql("prior", "aisle_id", "ua")))
def _(t):
    return rounded(B.user_group_features(prior(t)[1], "aisle_id", "ua"))


@query("f03_user_department", basket_sql(group_sql("prior", "department_id", "ud")))
def _(t):
    return rounded(B.user_group_features(prior(t)[1], "department_id", "ud"))


F04_SQL = """SELECT *, round({p}_reorder / {p}_orders, 6) AS {p}_reorder_ratio FROM (
      SELECT user_id, {time}, count(*) AS {p}_product, CAST(sum(reordered) AS BIGINT) AS {p}_reorder,
        count(DISTINCT order_id) AS {p}_orders, count(DISTINCT department_id) AS {p}_department,
        count(DISTINCT aisle_id) AS {p}_aisle FROM prior GROUP BY ALL)
      JOIN {dep} USING (user_id, {time}) JOIN {aisle} USING (user_id, {time})"""


def user_time_sql(time, p):
    keys = ["user_id", time]
    return F04_SQL.format(
        p=p, time=time, dep=mode_sql("prior", keys, "department_id", p + "_mode_department"),
        aisle=mode_sql("prior", keys, "aisle_id", p + "_mode_aisle"),
    )


@query("f04_user_day", basket_sql(user_time_sql("order_dow", "ut")))
def _(t):
    return rounded(B.user_time_features(prior_lines(t, "user_id", "order_dow", "order_id", "department_id", "aisle_id", "reordered"), "order_dow", "ut"))


@query("f04_user_hour", basket_sql(user_time_sql("order_hour", "uh")))
def _(t):
    return rounded(B.user_time_features(prior_lines(t, "user_id", "order_hour", "order_id", "department_id", "aisle_id", "reordered"), "order_hour", "uh"))


@query("f05_user_product", basket_sql(UP_SQL))
def _(t):
    orders, lines = prior(t)
    users = orders.groupBy("user_id").agg(F.max("order_number").alias("user_orders"))
    return rounded(B.user_product_features(lines, users))


def prefixed_up(lines, orders, p):
    return f"SELECT user_id, product_id, COLUMNS('(up_.*)') AS '{p}\\1' FROM ({up_sql(lines, orders)})"


def window_sql(rows, p):
    return basket_sql(
        f"""SELECT * FROM (SELECT order_id, user_id, product_id FROM wl)
        LEFT JOIN ({product_sql('wl', p + 'prod_', False)}) USING (product_id)
        LEFT JOIN ({user_sql('wo', 'wl', p + 'user_')}) USING (user_id)
        LEFT JOIN ({prefixed_up('wl', 'wo', p)}) USING (user_id, product_id)""",
        f"""wo AS (SELECT * EXCLUDE (rd, ra) FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY order_number DESC) rd,
          row_number() OVER (PARTITION BY user_id ORDER BY order_number) ra FROM ord WHERE eval_set = 'prior') WHERE {rows}),
        wl AS (SELECT * FROM lines WHERE order_id IN (SELECT order_id FROM wo))""",
    )


@query("f06_last_three_orders", window_sql("rd <= 3", "r_"))
def _(t):
    return rounded(B.recent_features(*prior(t)))


@query("f07_orders_two_to_four", window_sql("ra BETWEEN 2 AND 4", "e_"))
def _(t):
    return rounded(B.early_features(*prior(t)))


def share_sql(g, s):
    return f"""(SELECT {g}, product_id, round(n / sum(n) OVER (PARTITION BY {g}), 6) AS n_{s}p_ratio, round(u / pu, 6) AS u_{s}p_ratio
      FROM (SELECT {g}, product_id, count(*) n, count(DISTINCT user_id) u FROM again GROUP BY ALL)
      JOIN (SELECT {g}, count(DISTINCT user_id) pu FROM again GROUP BY 1) USING ({g}))"""


def repeat_sql(g, s):
    return f"""(SELECT {g}, count(DISTINCT user_id) FILTER (reordered = 1) AS repeat_{s},
      round(count(DISTINCT user_id) FILTER (reordered = 1) / count(DISTINCT user_id), 6) AS repeat_{s}_ratio
      FROM prior GROUP BY 1 HAVING count(*) FILTER (reordered = 1) > 0)"""


REPEAT_SQL = f"""SELECT b.*, repeat_d, repeat_d_ratio, repeat_p, repeat_p_ratio, n_ap_ratio, u_ap_ratio, n_dp_ratio, u_dp_ratio,
      round(coalesce(d1, 0), 6) AS repeat_buy_day, round(coalesce(d2, 0), 6) AS repeat_buy_day_o,
      round(coalesce(d3, 0), 6) AS repeat_buy_day_p, round(coalesce(d2 / nullif(d3, 0), 0), 6) AS repeat_buy_day_ratio
    FROM (SELECT DISTINCT user_id, product_id, aisle_id, department_id FROM prior) b
    LEFT JOIN {repeat_sql('department_id', 'd')} USING (department_id)
    LEFT JOIN {repeat_sql('product_id', 'p')} USING (product_id)
    LEFT JOIN {share_sql('aisle_id', 'a')} USING (aisle_id, product_id)
    LEFT JOIN {share_sql('department_id', 'd')} USING (department_id, product_id)
    LEFT JOIN (SELECT user_id, product_id, avg(days_since_prior) d1, avg(days_since_prior) FILTER (reordered = 1) d2
      FROM prior GROUP BY ALL) USING (user_id, product_id)
    LEFT JOIN (SELECT product_id, avg(days_since_prior) d3 FROM again GROUP BY 1) USING (product_id)"""


@query("f08_repeat_buyers", basket_sql(REPEAT_SQL, "again AS (SELECT * FROM prior WHERE reordered = 1)"))
def _(t):
    return rounded(B.repeat_buyer_features(prior(t)[1]))


PATTERN = """st AS (SELECT user_id, product_id, order_id, order_number,
    CAST(sum(days_since_prior) OVER w AS BIGINT) AS cumsum_order_day, row_number() OVER w AS place,
    count(*) OVER (PARTITION BY user_id, product_id) AS n,
    CASE WHEN row_number() OVER w = 1 THEN 0 ELSE days_since_prior END AS diff_order_day
    FROM prior WHERE reordered = 1 WINDOW w AS (PARTITION BY user_id, product_id ORDER BY order_number)),
  agg AS (SELECT user_id, product_id, avg(order_number) m, avg(order_number) / max(order_number) s,
    avg(diff_order_day) AS mean_diff_order_day,
    avg(CASE WHEN place BETWEEN 2 AND 4 THEN diff_order_day END) AS e_mean_diff_order_day,
    avg(CASE WHEN place >= n - 1 THEN diff_order_day END) AS r_mean_diff_order_day FROM st GROUP BY ALL),
  lim AS (SELECT min(m) m0, max(m) m1, min(s) s0, max(s) s1 FROM agg),
  pattern AS (SELECT user_id, product_id, order_id, cumsum_order_day, CAST(diff_order_day AS BIGINT) AS diff_order_day,
    round(mean_diff_order_day, 6) AS mean_diff_order_day, round((m - m0) / (m1 - m0), 6) AS order_number_mean,
    round((s - s0) / (s1 - s0), 6) AS order_number_skew, round(coalesce(e_mean_diff_order_day, 0), 6) AS e_mean_diff_order_day,
    round(coalesce(r_mean_diff_order_day, 0), 6) AS r_mean_diff_order_day
    FROM st JOIN agg USING (user_id, product_id), lim)"""


@query("f09_purchase_pattern", basket_sql("SELECT * FROM pattern", PATTERN))
def _(t):
    return rounded(B.pattern_features(prior(t)[1]))


MARKOV = """tr AS (SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.order_number, b.nxt) AS order_number,
    coalesce(a.product_id, b.product_id) AS product_id, b.product_id IS NOT NULL AS before, a.product_id IS NOT NULL AS now
    FROM (SELECT * FROM {src} WHERE order_number > 1) a FULL JOIN (SELECT *, order_number + 1 AS nxt FROM {src}
      JOIN (SELECT user_id, max(order_number) AS last_order FROM {src} GROUP BY 1) USING (user_id) WHERE order_number < last_order) b
    ON a.user_id = b.user_id AND a.order_number = b.nxt AND a.product_id = b.product_id),
  cnt AS (SELECT product_id, count(*) FILTER (before) n1, count(*) FILTER (before AND now) n11,
    count(*) FILTER (before AND NOT now) n10, count(*) FILTER (now AND NOT before) n01 FROM tr GROUP BY 1),
  big AS (SELECT {n} AS n FROM ord WHERE {osrc}),
  trans AS (SELECT product_id, (n - n1 + 1) / (n + 2) AS "P0", (n - n1 - n01 + 1) / (n - n1 + 2) AS "P00",
    (n01 + 1) / (n - n1 + 2) AS "P01", (n1 + 1) / (n + 2) AS "P1", (n10 + 1) / (n1 + 2) AS "P10",
    (n11 + 1) / (n1 + 2) AS "P11" FROM cnt, big)"""
PRIOR_MARKOV = MARKOV.format(src="prior", n="count(*) FILTER (order_number > 1)", osrc="eval_set = 'prior'")
MARKOV_ROWS = """(SELECT l.order_id, l.user_id, l.product_id, l.reordered AS pre_reorder,
    round(CASE WHEN reordered = 1 THEN "P1" ELSE "P0" END, 6) AS "P0",
    round(CASE WHEN reordered = 1 THEN "P10" ELSE "P00" END, 6) AS "P1",
    round(CASE WHEN reordered = 1 THEN "P11" ELSE "P01" END, 6) AS "P2"
    FROM prior l LEFT JOIN trans USING (product_id) WHERE l.order_number = l.n_orders - 2)"""


@query("f10_markov", basket_sql(f"SELECT * FROM {MARKOV_ROWS}", PRIOR_MARKOV))
def _(t):
    return rounded(B.markov_features(*prior(t)))


def window_ctes(rows, p):
    """The orders and lines of one window of prior orders."""
    return f"""{p}o AS (SELECT * EXCLUDE (rd, ra) FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY order_number DESC) rd,
        row_number() OVER (PARTITION BY user_id ORDER BY order_number) ra FROM ord WHERE eval_set = 'prior') WHERE {rows}),
      {p}l AS (SELECT * FROM lines WHERE order_id IN (SELECT order_id FROM {p}o))"""


def window_joins(p):
    return f"""LEFT JOIN ({product_sql(p + 'l', p + 'prod_', False)}) {p}1 ON {p}1.product_id = f.product_id
      LEFT JOIN ({user_sql(p + 'o', p + 'l', p + 'user_')}) {p}2 ON {p}2.user_id = f.user_id
      LEFT JOIN ({prefixed_up(p + 'l', p + 'o', p)}) {p}3 ON {p}3.user_id = f.user_id AND {p}3.product_id = f.product_id"""


def window_columns(p):
    return f"{p}1.* EXCLUDE (product_id), {p}2.* EXCLUDE (user_id), {p}3.* EXCLUDE (user_id, product_id)"


@query("f11_candidate_rows", basket_sql(
    f"""SELECT f.*, f2.aisle_id, f2.department_id, now.* EXCLUDE (user_id), pr.* EXCLUDE (product_id), us.* EXCLUDE (user_id),
        a.* EXCLUDE (user_id, aisle_id), d.* EXCLUDE (user_id, department_id),
        ut.* EXCLUDE (user_id, order_dow), uh.* EXCLUDE (user_id, order_hour), {window_columns('r_')}, {window_columns('e_')},
        rb.* EXCLUDE (user_id, product_id), round(vec.x, 6) AS x, round(vec.y, 6) AS y,
        pt.mean_diff_order_day, pt.order_number_mean, mk."P0", mk."P1", mk."P2",
        CAST(lab.product_id IS NOT NULL AS BIGINT) AS label
      FROM ({UP_SQL}) f JOIN (SELECT product_id, min(aisle_id) AS aisle_id, min(department_id) AS department_id FROM prior GROUP BY 1) f2 USING (product_id)
      JOIN (SELECT user_id, order_id, order_dow, order_hour, days_since_prior AS time_since_last_order
        FROM ord WHERE eval_set = 'train') now USING (user_id)
      LEFT JOIN ({product_sql('prior')}) pr USING (product_id)
      LEFT JOIN ({user_sql('po', 'prior')}) us ON us.user_id = f.user_id
      LEFT JOIN ({group_sql('prior', 'aisle_id', 'ua')}) a ON a.user_id = f.user_id AND a.aisle_id = f2.aisle_id
      LEFT JOIN ({group_sql('prior', 'department_id', 'ud')}) d ON d.user_id = f.user_id AND d.department_id = f2.department_id
      LEFT JOIN ({user_time_sql('order_dow', 'ut')}) ut ON ut.user_id = f.user_id AND ut.order_dow = now.order_dow
      LEFT JOIN ({user_time_sql('order_hour', 'uh')}) uh ON uh.user_id = f.user_id AND uh.order_hour = now.order_hour
      {window_joins('r_')} {window_joins('e_')}
      LEFT JOIN (SELECT * EXCLUDE (aisle_id, department_id) FROM ({REPEAT_SQL})) rb ON rb.user_id = f.user_id AND rb.product_id = f.product_id
      LEFT JOIN (SELECT product_id, avg(cart_pos) AS x, avg(order_number) AS y FROM prior GROUP BY 1) vec ON vec.product_id = f.product_id
      LEFT JOIN (SELECT user_id, product_id, max(mean_diff_order_day) AS mean_diff_order_day, max(order_number_mean) AS order_number_mean
        FROM pattern GROUP BY ALL) pt ON pt.user_id = f.user_id AND pt.product_id = f.product_id
      LEFT JOIN {MARKOV_ROWS} mk ON mk.user_id = f.user_id AND mk.product_id = f.product_id
      LEFT JOIN (SELECT user_id, product_id FROM lines WHERE eval_set = 'train') lab
        ON lab.user_id = f.user_id AND lab.product_id = f.product_id""",
    f"po AS (SELECT * FROM ord WHERE eval_set = 'prior'), again AS (SELECT * FROM prior WHERE reordered = 1), {PATTERN}, {PRIOR_MARKOV}, "
    + window_ctes("rd <= 3", "r_") + ", " + window_ctes("ra BETWEEN 2 AND 4", "e_")))
def _(t):
    orders, lines, parts = both_by_user(t)
    # a table of two numbers per product in the place of trained item vectors, so that the rows can be checked
    vectors = lines.where("eval_set = 'prior'").groupBy("product_id").agg(F.avg("cart_pos").alias("x"), F.avg("order_number").alias("y"))
    return rounded(B.candidate_rows(orders, lines, vectors=vectors, parts=parts))
