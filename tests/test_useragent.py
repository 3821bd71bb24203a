import pytest

from logsluice.functions.useragent import ua_browser, ua_os

CASES = [
    ("Agent/1 (Macintosh; Intel Mac OS X 12_6_1) Engine/9 Chrome/99.8.77 Safari/9", "chrome", "99.8.77", "mac", "12.6.1"),
    ("Dalvik/2.2.0 (Linux; U; Android 9.0.1; Own Phone)", "android", None, "android", "9.0.1"),
    ("Agent/1 (Windows NT 10.0; Trident/6.1; rv:12.5) own", "ie", "12.5", "windows", "10.0"),
    ("ELB-HealthChecker/3.7", "aws-elb", "3.7", "aws-elb", "3.7"),
    ("Mozilla/5.0 (iPhone; CPU iPhone OS 9_1 like Mac OS X) CriOS/47.0 Mobile", "chrome", "47.0", "ios", "9.1"),
    ("Mozilla/5.0 (X11; Ubuntu) Firefox/45.0", "firefox", "45.0", "unix", None),
    ("Mozilla/5.0 (Macintosh; Intel Mac OS X 10_12_0) Version/9.1 Safari/601", "safari", "9.1", "mac", "10.12"),
    ("Mozilla/4.0 (compatible; MSIE 8.0; Windows NT 5.1)", "ie", "8.0", "windows", "5.1"),
    ("Mozilla/5.0 (iPad) AppleWebKit/600", "ios_cna", None, None, None),
    ("Links (Linux)", None, None, "linux", None),
    ("", None, None, None, None),
]


@pytest.mark.parametrize("ua, browser, version, system, system_version", CASES)
def test_families(column, ua, browser, version, system, system_version):
    b = column([ua], ua_browser)[0]
    o = column([ua], ua_os)[0]
    assert (b and b.family, b and b.version) == (browser, version)
    assert (o and o.family, o and o.version) == (system, system_version)
