"""What train(labelled_pages()) of html_extract gives, to four places; a test trains again and compares."""

#: A weight a feature.
UNARY = {
    "bias": -0.4618,
    "tag_main": -1.7071,
    "tag_part": -1.3037,
    "tag_text": -0.6733,
    "tag_title": 0.3591,
    "tag_list": 1.4759,
    "tag_item": 1.3106,
    "tag_nav": 1.5199,
    "tag_head": 1.1126,
    "tag_foot": -0.4145,
    "tag_side": -0.0000,
    "tag_form": -0.2521,
    "name_main": 0.6384,
    "name_nav": -0.0002,
    "name_head": -1.1574,
    "name_foot": -0.2173,
    "name_side": -0.1017,
    "name_ad": -0.5624,
    "name_comment": -0.2851,
    "name_note": -0.2808,
    "name_share": -0.3980,
    "links": -2.8352,
    "text_some": 2.2017,
    "text_long": 3.3782,
    "stops": 6.2326,
    "few_words": -0.8024,
    "rights": -5.6013,
    "no_text": -3.0176,
    "below_links": -1.2263,
    "below_share": -0.7572,
    "below_long": -0.9737,
    "around_links": -1.1425,
    "around_share": -0.3146,
    "alone": -0.3125,
    "only": 2.8953,
    "off": -7.0550,
    "main": 1.8267,
    "main_links": 0.6394,
    "main_below_links": 0.9802,
    "main_few_words": 2.5160,
    "beside_links": -1.3275,
}
#: Log-potentials [kind of edge][parent][child].
PAIR = [[[-0.3157, -2.6355], [-1.2359, 3.3916]], [[0.4885, -3.228], [-0.0763, 1.9424]], [[0.7868, -3.9915], [0.7664, 1.4256]]]
