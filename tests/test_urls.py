"""Checks of URLs and hosts: expected findings written by hand."""

from courierlens.operators import urls

LISTS = urls.Lists(tlds=("top",), hosters=("pages.dev",), readable=("qingcloud", "strngth"), numeric=("163.com", "58921.com"), trusted=("trusted.example",), paths=("login", "verify", "secure"), params=("token", "redirect"))
HOSTS = {
    "evil.top": {"suspicious_tld"}, "wwwkp.domain.com": {"www_impersonation"}, "www-secure.domain.com": {"www_impersonation"}, "www2.domain.com": set(), "www.domain.com": set(), "x.pages.dev": {"free_hosting"}, "a.b.c.evil.com": {"deep_subdomain"}, "b.c.evil.com": set(),
    "snajgcb.com": {"random_domain"}, "fdtujh.com": {"random_domain"}, "fdtujh.co.uk": {"random_domain"}, "strngth.com": set(), "55555.com": {"numeric_domain"}, "58921.com": set(), "192-168-1-1.evil.com": {"embedded_ip"}, "192-168-1-256.evil.com": set(), "a" + "ea" * 20 + ".com": {"long_domain"},
}
URLS = {
    "https://a.example/Login?token=1&amp;redirect=2": {"suspicious_path": 0.1, "suspicious_params": 0.16}, "https://a.example/x#login-verify": {"suspicious_path": 0.2}, "https://a.example/login/verify/secure/login": {"suspicious_path": 0.3}, "https://a.example/?tokens=1": {},
    "https://a.example/a%252Fb": {"double_encoding": 0.25}, "https://a.example/a%2Fb%5Cc": {"encoded_separator": 0.15}, "http://user@evil.example/": {"at_sign_obfuscation": 0.35}, "https://fonts.example/css?wght@700": {}, "https://a.example/" + "x" * 390: {"long_url": 0.10}, "https://m.trusted.example/login?token=1": {}, "https://a.example?q=login": {},
}


def test_hosts_and_urls_by_hand(spark):
    found = {h: set() for h in HOSTS}
    for r in urls.host_findings(spark.createDataFrame([(h,) for h in HOSTS] * 2, "host string"), LISTS).collect():
        assert r.category not in found[r.host]
        found[r.host].add(r.category)
    assert found == HOSTS
    found = {u: {} for u in URLS}
    for r in urls.url_findings(spark.createDataFrame([(u,) for u in URLS], "url string"), LISTS).collect():
        found[r.url][r.category] = round(r.score, 9)
    assert found == URLS


def test_scores_of_messages_and_domains(spark):
    links = spark.createDataFrame([(1, "https://evil.top/login"), (1, "https://a.example/"), (1, "https://a.example/"), (2, "https://www-x.evil.top/"), (3, "https://a.example/"), (4, None), (4, "no url")], "id long, url string")
    found = urls.findings(links, LISTS)
    assert {tuple(map(lambda v: round(v, 9), r)) for r in urls.message_scores(links, found, "id").collect()} == {(1, 2, 0.15, 0.1), (2, 1, 0.4, 0.0), (3, 1, 0.0, 0.0), (4, 2, 0.0, 0.0)}
    assert [(r.domain, r.n_messages, r.n_urls, round(r.score, 9)) for r in urls.domain_scores(links, found, "id").collect()] == [("evil.top", 2, 2, 0.4)]
    assert urls.findings(links.limit(0), LISTS).collect() == []
