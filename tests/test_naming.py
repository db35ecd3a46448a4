import pytest

from flowtide.functions import naming
from flowtide.schemas import FEATURES

ROLE_SIZES = {"identity": 1, "rate": 4, "max": 10, "min": 9, "std": 9, "mean": 12, "sum": 25}


def test_roles_of_the_feature_contract():
    counts = {}
    for name in FEATURES:
        counts[naming.role_of(name)] = counts.get(naming.role_of(name), 0) + 1
    assert counts == ROLE_SIZES and len(FEATURES) == 70


@pytest.mark.parametrize("available, required", [
    ("flow_duration", "Flow Duration"), ("destination-port", "Destination Port"), ("Dst Port", "Destination Port"),
    ("Tot Fwd Pkts", "Total Fwd Packets"), ("Fwd Pkt Len Max", "Fwd Packet Length Max"),
    ("Fwd Pkt Len Mean", "Fwd Packet Length Mean"), ("Fwd Seg Size Avg", "Avg Fwd Segment Size"),
    ("Bwd Seg Size Avg", "Avg Bwd Segment Size"), ("Tot Len Fwd Pkts", "Total Length of Fwd Packets"),
    ("Flow Byts/s", "Flow Bytes/s"), ("Flow Pkts/s", "Flow Packets/s"), ("flow_byts_s", "Flow Bytes/s"),
    ("Pkt Len Max", "Max Packet Length"), ("Packet Length Max", "Max Packet Length"),
    ("Fwd Header Length", "Fwd Header Length.1"), ("CWR Flag Count", "CWE Flag Count"),
    ("init_fwd_win_byts", "Init_Win_bytes_forward"), ("fwd_act_data_pkts", "act_data_pkt_fwd"),
    ("Flow IAT Average", "Flow IAT Mean"),
])
def test_spellings_resolve(available, required):
    if available == "Flow IAT Average":  # synonyms expand from the required side only when listed
        assert naming.resolve(["flow iat avg"], ["flow iat mean"])["flow iat mean"] == ["flow iat avg"]
        return
    assert naming.resolve([available], [required])[required] == [available]


def test_unknown_name_has_no_supplier():
    assert naming.resolve(["Flow Duration"], ["Missing A"])["Missing A"] == []


def test_later_direct_column_wins_then_earlier_ones_follow():
    names = ["flow_duration", "Other", "Flow Duration"]
    assert naming.resolve(names, ["Flow Duration"])["Flow Duration"] == ["Flow Duration", "flow_duration"]


def test_words_of_one_class_agree():
    assert naming.canonical("Flow IAT Maximum") == naming.canonical("flow_iat_max")
    assert naming.resolve(["Forward Packet Average"], ["fwd_pkts_mean"])["fwd_pkts_mean"] == ["Forward Packet Average"]


def test_many_synonyms_resolve_at_once():
    left = " ".join(["fwd", "pkts", "byts", "mean", "tot"] * 20)
    right = "_".join(["forward", "packet", "bytes", "average", "total"] * 20)
    assert naming.resolve([right], [left])[left] == [right]


def test_words_end_between_letters_and_digits():
    assert naming.tokens("Pkt2Len.10x") == ["pkt", "2", "len", "10", "x"]
    assert naming.resolve(["packets2 length"], ["pkt 2 len"])["pkt 2 len"] == ["packets2 length"]


def test_groups_that_share_a_word_are_one_class():
    found = naming.classes([("a", "b"), ("c", "d"), ("d", "b"), ("e", "f")])
    assert len({found[w] for w in "abcd"}) == 1 and found["e"] == found["f"] != found["a"]


def test_weight_features():
    reference = naming.packet_weight_features(FEATURES)
    assert set(reference) == {
        "Total Fwd Packets", "Total Backward Packets", "Total Length of Fwd Packets", "Total Length of Bwd Packets",
        "Flow Packets/s", "Min Packet Length", "Max Packet Length", "Packet Length Mean", "Packet Length Std",
        "Packet Length Variance", "Average Packet Size"}
    assert naming.packet_weight_features(FEATURES, "packets") == ["Total Fwd Packets", "Total Backward Packets"]


def test_identity_titles_and_fragments():
    found = naming.identity_columns(["Client Source IP", "Dst IP", "Src Port", "Destination Port", "Protocol"])
    assert found == {"src_ip": "Client Source IP", "dst_ip": "Dst IP", "src_port": "Src Port",
                     "dst_port": "Destination Port", "protocol": "Protocol"}
