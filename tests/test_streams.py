from attestor.streaming.claims import wait_until_stable


def test_wait_until_stable():
    clock = [0.0]
    counts = iter([1, 2, 3] + [3] * 100)

    def sleep(seconds):
        clock[0] += seconds

    assert wait_until_stable(lambda: next(counts), 1, 5, 60, sleep, lambda: clock[0]) == (3, True)
    growing = iter(range(1000))
    clock[0] = 0.0
    assert wait_until_stable(lambda: next(growing), 1, 5, 20, sleep, lambda: clock[0])[1] is False
